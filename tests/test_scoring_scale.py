"""Scoring: what must stay small or be written once as the tables grow."""

import random

from pyspark.sql import functions as F

from attestra.operators import rules, skew as sk
from attestra.plans import scoring
from attestra.policy import Policy, Skew
from replay import random_rows, replay, to_frame


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(20_000).selectExpr("id AS seq", "CASE WHEN id % 10 = 0 THEN concat('k', id % 7) END AS k")
    sizes = sk.slotted(df, "k", None, Skew()).filter("k IS NULL").groupBy("_slot").count()
    assert sizes.count() > 1 and sizes.agg(F.max("count")).first()[0] <= 4096


def test_values_are_counted_one_by_one_only_in_crowded_buckets(spark, monkeypatch):
    written = []

    def seen(df, name="step"):
        written.append((name, df))
        return df
    monkeypatch.setattr(sk, "durable", seen)
    df = spark.range(400).selectExpr("concat('a', id) AS a", "if(id < 60, NULL, 'b') AS b", "id AS c")
    assert sk.hot_values(df, ["a"], Skew(hot_rows=50)) == {"a": None} and [n for n, _ in written] == ["crowded"]
    hot = sk.hot_values(df, ["a", "b", "c"], Skew(hot_rows=50))
    assert hot["a"] is None and hot["c"] is None and [r["b"] for r in hot["b"].collect()] == ["b"]


def test_undecided_rows_are_written_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = random_rows(rng, 120, span=1500)
    want = {r["record_id"]: d for r, (*_, d) in zip(rows, replay(rows))}
    written, durable = [], scoring.durable

    def seen(df, name="step"):
        written.append(name)
        return durable(df, name)
    monkeypatch.setattr(scoring, "durable", seen)
    # Lists longer than the bound are joined without a hint; the answer is the same.
    for most in (100_000, 1):
        written.clear()
        got = scoring.score_attempts(to_frame(spark, rows), skew=Skew(broadcast_values=most)).select("record_id", "decision").collect()
        assert dict(got) == want and written.count("candidates") == 1 and written.count("blocked") > 1


def test_reasons_need_no_lambda(spark):
    fired = [rules.Rule("A", F.col("id") > 0, rules._filled("%d rows: %s", F.col("id"), F.col("s"))),
             rules.Rule("B", F.col("id") == 5, F.lit("never")), rules.Rule("C", F.lit(True), F.lit("always"))]
    df = spark.range(2).withColumn("s", F.lit(None).cast("string")).select("id", rules.reasons(fired, Policy()).alias("r"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [[(x["rule"], x["description"]) for x in r["r"]] for r in df.orderBy("id").collect()] == [
        [("C", "always")], [("A", "1 rows: null"), ("C", "always")]]
