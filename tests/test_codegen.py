"""The code path production takes: the other tests run interpreted to save compile time."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import clean
from attestra.operators import temporal
from attestra.policy import Skew


@pytest.fixture
def compiled(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def events(spark):
    return spark.range(400).selectExpr(
        "id AS record_id", "id AS seq", "id div 3 AS sec", "concat('ip', id % 3 div 2) AS ip_address",
        "concat('u', id * 7 % 11) AS claimed_user_ref")


def test_cleaning_compiles(compiled):
    df = compiled.createDataFrame([("2024-01-02T05:06:07+04:00",), ("1700000000",), ("x",)], "t string")
    plan = df.select(F.unix_timestamp(clean.parse_timestamp(F.col("t"))).alias("s"), clean.to_double(F.col("t")).alias("d"))
    assert [tuple(r) for r in plan.collect()] == [(1704157567, None), (1700000000, 1.7e9), (None, None)]


def test_split_counts_compile_and_stay_small(compiled):
    """T3 with every address hot: equal answers, and no slot holds much more than a block of marks."""
    df = events(compiled)
    skew = Skew(hot_rows=50, block_rows=40)
    split = temporal.account_spread(df, 10, skew=skew).select("seq", "velocity_account_spread").collect()
    whole = temporal.account_spread(df, 10).select("seq", "velocity_account_spread").collect()
    assert sorted(split) == sorted(whole)
