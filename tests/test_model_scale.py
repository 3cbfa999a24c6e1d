"""A forest is trained on, and asked about, different vectors; every row still counts."""

from pyspark.sql import functions as F

from attestra.operators import model as ml
from attestra.schema import FEATURES
from attestra.session import durable


def _matrix(spark, counts):
    """``counts``: (velocity, label) -> rows."""
    rows = [(float(v), label) for (v, label), n in counts.items() for _ in range(n)]
    d = spark.createDataFrame(rows, "velocity_ip_count double, label string")
    return durable(d.select(*[F.col(n) if n == "velocity_ip_count" else F.lit(0.0).alias(n) for n in FEATURES], "label"))


COUNTS = {(0, "LEGITIMATE"): 500, (1, "LEGITIMATE"): 40, (2, "LEGITIMATE"): 3, (2, "FRAUD"): 1, (3, "FRAUD"): 700}


def test_instances_stand_for_all_rows_and_are_bounded_by_vectors(spark):
    got = {(r["velocity_ip_count"], r["label"]): (r["k"], r["rows"]) for r in ml.instances(_matrix(spark, COUNTS), 32).groupBy(
        "velocity_ip_count", "label").agg(F.count("*").alias("k"), F.sum("n").alias("rows")).collect()}
    assert got == {(float(v), label): (min(n, 32), float(n)) for (v, label), n in COUNTS.items()}


def test_training_sees_bounded_instances_with_class_weights(spark, monkeypatch):
    seen, kept = [], ml.instances
    monkeypatch.setattr(ml, "instances", lambda m: seen.append(kept(m)) or seen[-1])
    matrix = _matrix(spark, COUNTS)
    forest = ml.train_model(matrix, trees=5)
    assert seen[0].count() == 32 + 32 + 3 + 1 + 32 and matrix.count() == 1244
    p = ml.predicted_label(ml.fraud_probability(matrix, forest), forest)
    assert p.filter("velocity_ip_count < 2 AND prediction <> 'LEGITIMATE' OR velocity_ip_count = 3 AND prediction <> 'FRAUD'").isEmpty()


def test_each_vector_is_asked_once_and_every_row_answered(spark):
    matrix = _matrix(spark, COUNTS).withColumn("velocity_ip_count", F.when(F.col("velocity_ip_count") <= 2, F.col("velocity_ip_count")))
    asked = []

    def answers(v):
        asked.append(v.count())
        return v.withColumn("twice", 2 * F.coalesce("velocity_ip_count", F.lit(3.0)))

    got = {(r["twice"], r["label"]): r["count"] for r in ml.by_vector(matrix, answers).groupBy("twice", "label").count().collect()}
    assert asked == [4]
    assert got == {(2.0 * v, label): n for (v, label), n in COUNTS.items()}
