"""ST2: trailing counts on a stream, as keyed state or, where one key may fill a micro-batch, in blocks of the order."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from attestra.operators.ordering import dense_rank_in_order
from attestra.operators.skew import hot_values
from attestra.operators.temporal import account_spread, trailing_count
from attestra.policy import Skew
from attestra.session import durable
from attestra.streaming.state import _folder, finished

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


PACK = 10_000


def packed(entries: Iterable[tuple]) -> list[tuple]:
    """Entries as rows of a list state: a row holds the columns of up to ``PACK`` entries as arrays, so one call moves many."""
    rows, entries = [], iter(entries)
    while part := list(islice(entries, PACK)):
        rows.append(tuple(list(c) for c in zip(*part)))
    return rows


def unpacked(rows: Iterable[tuple]) -> Iterator[tuple]:
    for columns in rows:
        yield from zip(*columns)


class TrailingCounts(StatefulProcessor):
    """Per key: rows and distinct members per second, kept only while a window can still see them.

    State is rows by (second, member), read and written at once, so its size follows the window and not the traffic. A timer
    per key drops what the watermark has passed, so keys that fall silent leave nothing behind. Rows of a
    micro-batch are taken in time order, each in constant time on average; a late row sees the state of
    its own window.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "sec array<long>, member array<string>, n array<long>")

    def _kept(self) -> dict:
        return {(sec, member): n for sec, member, n in unpacked(self.seen.get())}

    def _keep(self, kept: dict, watermark_ms: int, spare=()) -> None:
        """Store what a window can still reach and set the timer by its latest second."""
        horizon = watermark_ms // 1000 - self.seconds
        left = {k: n for k, n in kept.items() if k[0] >= horizon or k in spare}
        if not left:
            self.seen.clear()
            return
        self.seen.put(packed((*k, n) for k, n in left.items()))
        self.handle.registerTimer((max(k[0] for k in left) + self.seconds + 2) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        batch = pd.concat(list(rows)).sort_values(["ts", "record_id"], kind="stable")
        later = sorted(kept)                    # state not yet inside the moving window
        live: deque = deque()                   # (second, member, rows) inside the window, oldest first
        members: Counter = Counter()
        rows_in = named = i = 0
        answers, changed = [], {}

        def enter(sec, member, n):
            nonlocal rows_in, named
            live.append((sec, member, n))
            rows_in += n
            named += member != "" and not members[member]
            members[member] += n

        for record_id, sec, member_here, counts in zip(*(batch[c].tolist() for c in ("record_id", "sec", "member", "counts"))):
            while i < len(later) and later[i][0] <= sec:
                enter(*later[i], kept[later[i]])
                i += 1
            while live and live[0][0] < sec - self.seconds:
                _, member, n = live.popleft()
                rows_in -= n
                members[member] -= n
                if not members[member]:
                    del members[member]
                    named -= member != ""
            answers.append((record_id, sec, rows_in, named))
            if counts:
                member = member_here or ""
                enter(sec, member, 1)
                changed[(sec, member)] = changed.get((sec, member), kept.get((sec, member), 0)) + 1
        self._keep({**kept, **changed}, timerValues.getCurrentWatermarkInMs(), changed)
        yield pd.DataFrame(answers, columns=["record_id", "sec", "rows_before", "members_before"]).assign(
            key=key[0])[["key", "record_id", "sec", "rows_before", "members_before"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._kept(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def stream_velocity(source: DataFrame, key: str = "ip_address", seconds: int = 60,
                    member: str = "claimed_user_ref", where=None, delay: str = "10 minutes") -> DataFrame:
    """T2/T3 (key ``ip_address``) or T4 (key ``claimed_user_ref``, ``where`` login failed) on a stream.

    ``rows_before`` is the trailing count and ``members_before`` the distinct members, both before the
    row itself. Rows later than ``delay`` may find their window pruned.
    """
    source.sparkSession.conf.set(*ROCKSDB)
    counts = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    d = (source.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
         .withWatermark("ts", delay)
         .select(F.col(key).alias("key"), "record_id", "ts", F.unix_timestamp("ts").alias("sec"),
                 F.col(member).alias("member"), counts.alias("counts")))
    return d.groupBy("key").transformWithStateInPandas(
        TrailingCounts(seconds),
        outputStructType="key string, record_id long, sec long, rows_before long, members_before long",
        outputMode="Append", timeMode="EventTime")


COUNTS = "key string, sec long, member string, n long"


def velocity_batch(batch: DataFrame, batch_id: int, state: str, key: str = "ip_address", seconds: int = 60,
                   member: str = "claimed_user_ref", where=None, delay_seconds: int = 600, skew: Skew = Skew()) -> DataFrame:
    """One micro-batch of :func:`stream_velocity`, same answers, without a task that takes all rows of a key.

    The state is a table of rows per (key, second, member), summed before they are shuffled and kept while a
    window can still see them. It joins the batch as weighted rows that stand first in their second; a hot key is
    then cut into blocks of the order like any other. A batch that runs again reads the state it read first.
    """
    spark = batch.sparkSession
    counts = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = durable(batch.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.unix_timestamp("ts").alias("sec"),
        F.when(counts, F.nullif(F.col(member).cast("string"), F.lit(""))).alias("member"),
        counts.cast("long").alias("n"), "record_id", "ts", F.lit(True).alias("_new")), "velocity")
    done = [i for i in finished(spark, f"{state}/counts") if i < batch_id]
    kept = spark.createDataFrame([], COUNTS) if not done else \
        spark.read.schema(COUNTS).parquet(f"{state}/counts/batch_id={done[-1]}")
    low, high = rows.agg(F.min("sec"), F.max("sec")).first()
    if low is not None:
        seen = kept.filter(F.col("sec").between(low - seconds, high)).join(rows.select("key").distinct(), "key", "left_semi")
        both = rows.unionByName(seen.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        both = durable(dense_rank_in_order(both, [F.col(c).asc() for c in ("sec", "_new", "ts", "record_id")], "seq"), "placed")
        hot = hot_values(both, ["key"], skew)["key"]
        both = trailing_count(both, "key", seconds, "rows_before", hot=hot, skew=skew, weight=F.col("n"))
        both = account_spread(both, seconds, "members_before", "key", "member", hot=hot, skew=skew)
        last = max(high, kept.agg(F.max("sec")).first()[0] or high)
        kept.unionByName(rows.select(*kept.columns)).filter((F.col("n") > 0) & (F.col("sec") >= last - delay_seconds - seconds)) \
            .groupBy("key", "sec", "member").agg(F.sum("n").alias("n")) \
            .write.mode("overwrite").parquet(f"{state}/counts/batch_id={batch_id}")
        answers = both.filter("_new")
    else:
        answers = rows.withColumn("rows_before", F.lit(0).cast("long")).withColumn("members_before", F.lit(0).cast("long"))
    out = f"{state}/velocity/batch_id={batch_id}"
    answers = answers.select("key", "record_id", "sec", "rows_before", "members_before")
    answers.write.mode("overwrite").parquet(out)
    for i in done[:-1]:
        path, fs = _folder(spark, f"{state}/counts/batch_id={i}")
        fs.delete(path, True)
    return spark.read.schema(answers.schema).parquet(out)


def stream_velocity_blocks(source: DataFrame, state: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """ST2 for streams with hot keys: answers under ``velocity/`` of ``state``, one folder for each batch.

    ``options`` are those of :func:`velocity_batch`.
    """
    return (source.writeStream.foreachBatch(lambda b, i: velocity_batch(b, i, state, **options) and None)
            .option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start())
