"""ST3 on streams: challenges as keyed state with expiry timers, or judged against a table of challenges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestra.operators.stepup import DEMO_CODE, judge_responses
from attestra.policy import ALLOW, BLOCK
from attestra.streaming.scoring import RESOLVED, _table
from attestra.streaming.velocity import ROCKSDB, packed, unpacked

CODE = re.compile("[0-9]{6}")
OUTCOME = "attempt_ref string, response_id long, owner string, sec long, outcome string"


def resolve_batch(challenges: DataFrame, responses: DataFrame, batch_id: int, state_dir: str,
                  code: str = DEMO_CODE) -> DataFrame:
    """Judge one micro-batch. Challenges consumed in earlier batches count as resolved; the outcomes
    become part of the scorer's history, so a failed challenge flags its address and device."""
    spark = responses.sparkSession
    used = _table(spark, f"{state_dir}/resolved", RESOLVED, batch_id).select("attempt_ref").distinct()
    still = challenges.join(used, "attempt_ref", "left_anti")
    judged = judge_responses(still, responses, code)
    owned = challenges.join(used, "attempt_ref", "left_semi").select(
        "attempt_ref", F.col("owner"), F.lit(True).alias("_used"))
    judged = judged.join(owned, ["attempt_ref", "owner"], "left").withColumn(
        "outcome", F.when((F.col("outcome") == "NOT_FOUND") & F.col("_used"), F.lit("RESOLVED"))
        .otherwise(F.col("outcome"))).drop("_used").select(*responses.columns, "outcome")
    passed = F.col("outcome") == "PASSED"
    judged.filter(F.col("outcome").isin("PASSED", "FAILED")).select(
        "attempt_ref", F.when(passed, "PASS").otherwise("FAIL").alias("step_up_result"),
        F.when(passed, ALLOW).otherwise(BLOCK).alias("decision")) \
        .write.mode("overwrite").parquet(f"{state_dir}/resolved/batch_id={batch_id}")
    judged.write.mode("overwrite").parquet(f"{state_dir}/responses/batch_id={batch_id}")
    return spark.read.parquet(f"{state_dir}/responses/batch_id={batch_id}")


def stream_step_up(responses: DataFrame, read_challenges, state_dir: str, code: str = DEMO_CODE, **trigger):
    """Start the query; ``read_challenges()`` returns the challenges known when a batch begins."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        resolve_batch(read_challenges(), batch, batch_id, state_dir, code)

    return (responses.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{state_dir}/checkpoint-step-up")
            .trigger(**(trigger or {"availableNow": True})).start())


class Challenges(StatefulProcessor):
    """Per attempt: who owns its challenge, until when it is open, and whether it was used.

    The key is a bucket of attempts, so one call judges many of them and reads and writes its state at once. Responses of a micro-batch
    are judged in time order, each in constant time. A bucket's timer stands at the first end that is to come: a challenge that nobody
    used is reported as ``LAPSED`` then, and ``keep_seconds`` later its state goes, after which responses are ``NOT_FOUND``.
    """

    def __init__(self, code: str, keep_seconds: int):
        self.code, self.keep = code, keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState(
            "open", "attempt_ref array<string>, owner array<string>, expires array<long>, used array<boolean>, lapsed array<boolean>")

    def _held(self) -> dict:
        return {ref: tuple(rest) for ref, *rest in unpacked(self.open.get())}

    def _hold(self, held: dict) -> None:
        if held:
            self.open.put(packed((ref, *rest) for ref, rest in held.items()))
        else:
            self.open.clear()

    def _wake(self, held: dict, after_ms: int = -1) -> None:
        due = min((expires if not used and not lapsed else expires + self.keep for _, expires, used, lapsed in held.values()),
                  default=None)
        if due is not None and not any(after_ms < t <= due * 1000 for t in list(self.handle.listTimers())):
            self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        held, changed = self._held(), False
        opened = batch.loc[batch["opens"]]
        for ref, owner, expires in zip(opened["attempt_ref"], opened["owner"], opened["sec"]):
            if ref not in held:                     # a challenge that is delivered again changes nothing
                held[ref], changed = (owner, int(expires), False, False), True
        out = []
        asked = batch[~batch["opens"]].sort_values(["sec", "response_id"], kind="stable")
        for ref, number, named, owner, code, sec in zip(*(asked[c] for c in (
                "attempt_ref", "response_id", "named", "owner", "code", "sec"))):
            mine = held.get(ref)
            if not isinstance(code, str) or not CODE.fullmatch(code):
                outcome = "MALFORMED"
            elif mine is None or owner != mine[0] or sec >= mine[1] + self.keep:     # whether or not the timer has fired
                outcome = "NOT_FOUND"
            elif mine[2]:
                outcome = "RESOLVED"
            elif sec >= mine[1]:
                outcome = "EXPIRED"
            else:
                outcome, changed = "PASSED" if code == self.code else "FAILED", True
                held[ref] = (mine[0], mine[1], True, mine[3])
            out.append((ref, number if named else None, owner, sec, outcome))
        if changed:
            self._hold(held)
        self._wake(held)
        yield _outcomes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, out = {}, []
        before = self._held()
        for ref, (owner, expires, used, lapsed) in before.items():
            if not used and not lapsed and expires * 1000 < now:
                out.append((ref, None, owner, expires, "LAPSED"))
                lapsed = True
            if (expires + self.keep) * 1000 >= now:
                held[ref] = (owner, expires, used, lapsed)
        if held != before:
            self._hold(held)
        self._wake(held, expiredTimerInfo.getExpiryTimeInMs())
        yield _outcomes(out)

    def close(self) -> None:
        pass


def _outcomes(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["attempt_ref", "response_id", "owner", "sec", "outcome"])
    return found.assign(response_id=pd.array([r[1] for r in rows], dtype="Int64"))


def judged_stream(challenges: DataFrame, responses: DataFrame, code: str = DEMO_CODE, delay: str = "10 minutes",
                  keep_seconds: int = 86_400, buckets: int = 1024) -> DataFrame:
    """ST3 on two streams: an outcome for each response, and ``LAPSED`` for challenges that nobody used in time.

    ``challenges`` has ``attempt_ref``, ``owner``, ``expires_sec`` and ``responses`` has ``response_id``, ``attempt_ref``, ``owner``,
    ``code``, ``answered_at``. Both carry a watermark; state is one small entry for each challenge and goes with its timer, and neither
    challenges nor outcomes are read again. A response must not arrive before its challenge. ``buckets`` is the number of keyed-state
    calls of a micro-batch at most; a call holds the open challenges and the new rows of one bucket of attempts.
    """
    responses.sparkSession.conf.set(*ROCKSDB)
    opened = challenges.withColumn("ts", F.timestamp_seconds("expires_sec")).withWatermark("ts", delay).select(
        "attempt_ref", "owner", F.lit(True).alias("opens"), F.lit(0).cast("long").alias("response_id"), F.lit(False).alias("named"),
        F.lit(None).cast("string").alias("code"), F.col("expires_sec").alias("sec"), "ts")
    # Ids stay whole numbers in a frame where some are missing.
    last = F.lit(2 ** 63 - 1)
    asked = responses.withColumn("ts", F.col("answered_at")).withWatermark("ts", delay).select(
        "attempt_ref", "owner", F.lit(False).alias("opens"), F.coalesce("response_id", last).cast("long").alias("response_id"),
        F.col("response_id").isNotNull().alias("named"), "code", F.unix_timestamp("answered_at").alias("sec"), "ts")
    rows = opened.unionByName(asked).filter("attempt_ref IS NOT NULL")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("attempt_ref"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        Challenges(code, keep_seconds), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")


def stream_resolutions(challenges: DataFrame, responses: DataFrame, state_dir: str, code: str = DEMO_CODE, delay: str = "10 minutes",
                       keep_seconds: int = 86_400, **trigger):
    """Start :func:`judged_stream`; outcomes go to ``responses/`` and decisions to the ``resolved/`` table the scorer reads."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        path = f"{state_dir}/responses/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        passed = F.col("outcome") == "PASSED"
        batch.sparkSession.read.schema(OUTCOME).parquet(path).filter(F.col("outcome").isin("PASSED", "FAILED")).select(
            "attempt_ref", F.when(passed, "PASS").otherwise("FAIL").alias("step_up_result"),
            F.when(passed, ALLOW).otherwise(BLOCK).alias("decision")) \
            .write.mode("overwrite").parquet(f"{state_dir}/resolved/batch_id={batch_id}")

    return (judged_stream(challenges, responses, code, delay, keep_seconds).writeStream.foreachBatch(handle).outputMode("append")
            .option("checkpointLocation", f"{state_dir}/checkpoint-step-up")
            .trigger(**(trigger or {"availableNow": True})).start())
