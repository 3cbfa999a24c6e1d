import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import stepup
from attestra.operators.ordering import chronological
from attestra.plans.scoring import score_attempts
from attestra.policy import Policy, Skew
from attestra.schema import conform
from attestra.session import durable
from attestra.streaming import scoring as ss
from attestra.streaming.state import Compaction, State, finished
from attestra.streaming.stepup import resolve_batch, stream_resolutions, stream_step_up
from attestra.streaming.velocity import stream_velocity, velocity_batch
from replay import random_rows, to_frame


@pytest.fixture(scope="module")
def batchwise(spark):
    rows = random_rows(random.Random(11), 60, span=600)
    df = durable(conform(to_frame(spark, rows)))
    want = {r["record_id"]: (r["risk_score"], r["decision"], [x["rule"] for x in r["reasons"]])
            for r in score_attempts(df).collect()}
    ordered = durable(chronological(df))
    return ordered, want


def answers(df):
    return {r["record_id"]: (r["risk_score"], r["decision"], [x["rule"] for x in r["reasons"]]) for r in df.collect()}


def test_micro_batches_give_the_batch_result(spark, batchwise, tmp_path):
    ordered, want = batchwise
    state, size = str(tmp_path), Compaction(every=1, bucket_rows=7)
    for i in range(3):
        ss.score_batch(ordered.filter(F.floor(F.col("seq") / 20) == i).drop("seq"), i, state, compaction=size)
    got = answers(spark.read.parquet(f"{state}/scored"))
    assert got == want
    # What only older batches could need is gone.
    assert finished(spark, f"{state}/manifest") == [1, 2] and finished(spark, f"{state}/edges/log") == [2]
    assert finished(spark, f"{state}/edges/snapshot", "upto=") == [1, 2]
    assert spark.read.parquet(f"{state}/edges/snapshot/upto=2").count() == \
        spark.read.parquet(f"{state}/history").filter("new_edge").count()
    # A batch that runs again overwrites itself and nothing else.
    again = ss.score_batch(ordered.filter(F.floor(F.col("seq") / 20) == 2).drop("seq"), 2, state, compaction=size)
    assert answers(again) == {k: v for k, v in want.items() if k in answers(again)}
    assert spark.read.parquet(f"{state}/history").count() == 60


def test_state_rebuilt_from_stored_attempts(spark, batchwise, tmp_path):
    ordered, want = batchwise
    first = ss.score_batch(ordered.filter("seq < 40").drop("seq"), 0, str(tmp_path / "a"))
    stored = first.withColumn("seq", F.col("seq"))
    state = str(tmp_path / "b")
    ss.rebuild_state(stored, state)
    late = ordered.filter("seq >= 40").drop("seq")
    got = answers(ss.score_batch(late, 0, state))
    assert got == {k: want[k] for k in got} and len(got) == 20
    # Rows further behind than allowed go to the side output and change nothing.
    old = late.withColumn("ts", F.col("ts") - F.expr("interval 1 day")).withColumn("sec", F.col("sec") - 86400)
    assert ss.score_batch(old, 1, state, max_delay_seconds=3600).count() == 0
    assert spark.read.parquet(f"{state}/late/batch_id=1").count() == 20


def test_step_up_lifecycle(spark, tmp_path):
    scored = spark.createDataFrame(
        [("A1", "STEP_UP", "own", 0), ("A2", "STEP_UP", "own", 0), ("A3", "ALLOW", "own", 0), ("A4", "STEP_UP", "own", 0)],
        "attempt_ref string, decision string, owner string, s long").withColumn("ts", F.timestamp_seconds("s"))
    answers_ = [(1, "A1", "own", "12", 10), (2, "A1", "other", "123456", 20), (3, "A1", "own", "123456", 30),
                (4, "A1", "own", "000000", 40), (5, "A2", "own", "000000", 50), (6, "A3", "own", "123456", 60),
                (7, "A4", "own", "123456", 300)]
    responses = spark.createDataFrame(answers_, "response_id long, attempt_ref string, owner string, code string, s long") \
        .withColumn("answered_at", F.timestamp_seconds("s"))
    ch = stepup.open_challenges(scored)
    got = {r["response_id"]: r["outcome"] for r in stepup.judge_responses(ch, responses).collect()}
    want = {1: "MALFORMED", 2: "NOT_FOUND", 3: "PASSED", 4: "RESOLVED", 5: "FAILED", 6: "NOT_FOUND", 7: "EXPIRED"}
    assert got == want
    after = {r["attempt_ref"]: (r["decision"], r["step_up_result"]) for r in stepup.resolve_step_up(scored, responses).collect()}
    assert after == {"A1": ("ALLOW", "PASS"), "A2": ("BLOCK", "FAIL"), "A3": ("ALLOW", None), "A4": ("STEP_UP", None)}
    streamed = {}
    for i in range(3):
        part = responses.filter((F.col("response_id") > 3 * i) & (F.col("response_id") <= 3 * i + 3))
        streamed.update({r["response_id"]: r["outcome"] for r in resolve_batch(ch, part, i, str(tmp_path)).collect()})
    assert streamed == want


def test_step_up_on_a_file_stream_feeds_history(spark, tmp_path):
    state = str(tmp_path / "state")
    row = conform(spark.createDataFrame([(0, "A1", "u", 100)], "record_id long, attempt_ref string, claimed_user_ref string, sec long")
                  .withColumn("ts", F.timestamp_seconds("sec")).withColumn("ip_address", F.lit("ip"))
                  .withColumn("device_id", F.lit("d")))
    ss.rebuild_state(row.withColumn("seq", F.lit(0).cast("long")).withColumn("decision", F.lit("STEP_UP")), state)
    ch = spark.createDataFrame([("A1", "own", 400)], "attempt_ref string, owner string, expires_sec long")
    src = spark.createDataFrame([(1, "A1", "own", "999999", 200)],
                                "response_id long, attempt_ref string, owner string, code string, s long") \
        .withColumn("answered_at", F.timestamp_seconds("s"))
    src.write.parquet(str(tmp_path / "in"))
    stream_step_up(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), lambda: ch, state).awaitTermination()
    nxt = row.withColumn("record_id", F.lit(1).cast("long")).withColumn("attempt_ref", F.lit("A2")) \
        .withColumn("claimed_user_ref", F.lit("v")).withColumn("ts", F.timestamp_seconds(F.lit(5000))) \
        .withColumn("sec", F.lit(5000).cast("long"))
    r = ss.score_batch(nxt, 0, state).first()
    assert [x["rule"] for x in r["reasons"]][:2] == ["IP_FLAGGED", "DEVICE_FLAGGED"]


def test_stream_velocity(spark, tmp_path):
    rows = random_rows(random.Random(5), 80, span=400)
    df = durable(to_frame(spark, rows)).select("record_id", "claimed_user_ref", "ts", "ip_address")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    half = rows[40]["sec"]
    for when in (F.unix_timestamp("ts") < half, F.unix_timestamp("ts") >= half):
        df.filter(when).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stream_velocity(src, seconds=60).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = {r["record_id"]: (r["rows_before"], r["members_before"]) for r in spark.read.parquet(out).collect()}
    for i, r in enumerate(rows):
        if r["ip"]:
            near = [p for p in rows[:i] if p["ip"] == r["ip"] and p["sec"] >= r["sec"] - 60]
            assert got[r["record_id"]] == (len(near), len({p["id"] for p in near if p["id"]}))


def test_hot_keys_of_a_stream_run_in_several_tasks(spark, tmp_path):
    rows = random_rows(random.Random(5), 80, span=400)
    df = durable(to_frame(spark, rows)).select("record_id", "claimed_user_ref", "ts", "ip_address")
    state, half, tiny = str(tmp_path), rows[40]["sec"], Skew(hot_rows=5, block_rows=6)
    for i, when in enumerate((F.unix_timestamp("ts") < half, F.unix_timestamp("ts") >= half)):
        batch = df.filter(when)
        got = {r["record_id"]: (r["rows_before"], r["members_before"])
               for r in velocity_batch(batch, i, state, seconds=60, skew=tiny).collect()}
        for j, r in enumerate(rows):
            if r["ip"] and (r["sec"] >= half) == (i == 1):
                near = [p for p in rows[:j] if p["ip"] == r["ip"] and p["sec"] >= r["sec"] - 60]
                assert got[r["record_id"]] == (len(near), len({p["id"] for p in near if p["id"]})), j
    assert velocity_batch(df.filter("false"), 2, state).isEmpty() and finished(spark, f"{state}/counts") == [1]
    # One address fills a batch: its rows are answered by several tasks, and what stays is one row a second and identity.
    crowd = spark.range(20_000).select(F.col("id").alias("record_id"), F.lit("u").alias("claimed_user_ref"), F.lit("x").alias("ip_address"),
                                       F.timestamp_seconds(F.floor(F.col("id") / 500) + 2_000_000_000).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = velocity_batch(crowd, 3, state, seconds=100, skew=Skew(hot_rows=1_000, block_rows=1_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert out.filter("rows_before <> record_id OR members_before <> IF(record_id = 0, 0, 1)").isEmpty() and out.count() == 20_000
    assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 15_000
    assert spark.read.parquet(f"{state}/counts/batch_id=3").filter("key = 'x'").count() == 40


def test_challenges_as_state_with_timers(spark, tmp_path):
    ch = spark.createDataFrame([(f"A{i}", "own", 300 + i) for i in range(6)], "attempt_ref string, owner string, expires_sec long")
    rows = [(1, "A0", "own", "12", 10), (2, "A0", "other", "123456", 20), (3, "A0", "own", "123456", 30), (4, "A1", "own", "000000", 40),
            (5, "A9", "own", "123456", 50), (6, "A0", "own", "000000", 60), (7, "A1", "own", "123456", 70), (8, "A2", "own", "123456", 302),
            (9, "A3", None, "123456", 302), (10, "A3", "own", "000000", 302), (11, "A3", "own", "123456", 302)]
    schema = "response_id long, attempt_ref string, owner string, code string, s long"
    responses = spark.createDataFrame(rows, schema).withColumn("answered_at", F.timestamp_seconds("s"))
    want = {r["response_id"]: r["outcome"] for r in stepup.judge_responses(ch, responses).collect()}
    ch.write.parquet(str(tmp_path / "ch"))
    state = str(tmp_path / "state")

    def deliver(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_resolutions(spark.readStream.schema(ch.schema).parquet(str(tmp_path / "ch")),
                           spark.readStream.schema(responses.schema).parquet(str(tmp_path / "in")), state, delay="0 seconds",
                           keep_seconds=1000).awaitTermination()

    for low, high in ((0, 25), (25, 65), (65, 400)):
        deliver(responses.filter((F.col("s") >= low) & (F.col("s") < high)))
    out = spark.read.parquet(f"{state}/responses")
    assert {r["response_id"]: r["outcome"] for r in out.filter("response_id IS NOT NULL").collect()} == want
    assert {"MALFORMED", "NOT_FOUND", "PASSED", "FAILED", "RESOLVED", "EXPIRED"} == set(want.values())
    # The challenge stream's own clock ended at 305, so only challenges before that have lapsed by now.
    late = spark.createDataFrame([(f"B{i}", "own", 5000 + i) for i in range(2)], ch.schema)
    late.write.mode("append").parquet(str(tmp_path / "ch"))
    deliver(spark.createDataFrame([(20, "B0", "own", "123456", 4000)], schema).withColumn("answered_at", F.timestamp_seconds("s")))
    out = spark.read.parquet(f"{state}/responses")
    assert {r["attempt_ref"] for r in out.filter("outcome = 'LAPSED'").collect()} == {"A2", "A4", "A5"}
    deliver(spark.createDataFrame([(21, "A0", "own", "123456", 4100), (22, "B1", "own", "000000", 4100)], schema)
            .withColumn("answered_at", F.timestamp_seconds("s")))
    got = {r["response_id"]: r["outcome"] for r in spark.read.parquet(f"{state}/responses").filter("response_id > 12").collect()}
    assert got == {20: "PASSED", 21: "NOT_FOUND", 22: "FAILED"}
    done = {r["attempt_ref"]: r["decision"] for r in spark.read.parquet(f"{state}/resolved").collect()}
    assert done == {"A0": "ALLOW", "A1": "BLOCK", "A3": "BLOCK", "B0": "ALLOW", "B1": "BLOCK"}


def test_a_batch_reads_what_it_needs_and_not_the_history(spark, tmp_path):
    """The same few attempts after 1,004 and after 6,002 attempts of other people: the bytes read stay the same."""
    people = durable(conform(spark.range(6_006).select(
        F.col("id").alias("record_id"), F.format_string("A%d", "id").alias("attempt_ref"),
        F.format_string("u%d", F.floor(F.col("id") / 3)).alias("claimed_user_ref"),
        F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.format_string("ip%d", F.col("id")).alias("ip_address"),
        F.format_string("d%d", F.floor(F.col("id") / 2)).alias("device_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("address"))).withColumn("seq", F.col("record_id")))
    status = spark.sparkContext._jsc.sc().statusStore()

    def cost(n):
        state = str(tmp_path / str(n))
        ss.rebuild_state(people.filter(F.col("seq") < n).withColumn("decision", F.when(F.col("seq") % 2 == 0, "BLOCK").otherwise("ALLOW")),
                         state, Compaction(bucket_rows=100))
        few = durable(people.filter((F.col("seq") >= n) & (F.col("seq") < n + 4)))
        before = status.executorSummary("driver").totalInputBytes()
        now = State(spark, state, 0)
        _, _, stored = now.labels(few)
        old = ss.relevant_history(now, few, people.withColumn("decision", F.lit("")).filter("false"), stored, Policy())
        found = {r["seq"] for r in old.select("seq").collect()}
        return status.executorSummary("driver").totalInputBytes() - before, found

    small, found = cost(1004)
    large, later = cost(6002)
    # The identity of the two attempts before goes on; nobody else shares anything with the batch.
    assert found == {1002, 1003} and later == {6000, 6001}
    assert large < 1.3 * small, (small, large)


def test_a_repeated_batch_does_not_see_later_outcomes(spark, tmp_path):
    root = str(tmp_path)
    row = conform(spark.createDataFrame([(0, "A1", "u", 100)], "record_id long, attempt_ref string, claimed_user_ref string, sec long")
                  .withColumn("ts", F.timestamp_seconds("sec")).withColumn("device_id", F.lit("d")))
    ss.rebuild_state(row.withColumn("seq", F.lit(0).cast("long")).withColumn("decision", F.lit("STEP_UP")), root)
    assert ss._failed(State(spark, root, 0)).isEmpty()
    spark.createDataFrame([("A1", "FAIL", "BLOCK")], "attempt_ref string, step_up_result string, decision string") \
        .write.parquet(f"{root}/resolved/batch_id=0")
    assert ss._failed(State(spark, root, 0)).isEmpty()
    assert [(r["seq"], r["decision"]) for r in ss._failed(State(spark, root, 1)).collect()] == [(0, "BLOCK")]
    assert ss._failed(State(spark, root, 2)).isEmpty()
