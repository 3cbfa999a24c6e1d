"""Total order of attempts and the distributed prefix sums it rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.session import durable

_POS_BITS = 33


def dense_rank_in_order(df: DataFrame, order: Sequence[Column], out: str,
                        weight: Column | None = None) -> DataFrame:
    """Add ``out``: how many rows (or how much ``weight``) stand before this one in ``order``.

    One range exchange sorts the rows over all tasks. Row positions then need no second
    exchange: they are the position inside the task plus the row count of the tasks before,
    and the latter table has one row per task.
    """
    placed = (df.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long"))
              .orderBy(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_mid", _POS_BITS).cast("int")))
    placed = durable(placed, "ordered")
    sums = placed.groupBy("_part").agg(F.sum("_w").alias("_s"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = durable(sums.select(
        "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")).coalesce(1), "offsets")
    joined = placed.join(F.broadcast(offsets), "_part")
    if weight is None:
        rank = F.col("_off") + F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1)
    else:
        inside = W.partitionBy("_part").orderBy("_mid").rowsBetween(W.unboundedPreceding, -1)
        rank = F.col("_off") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    return joined.withColumn(out, rank.cast("long")).drop("_w", "_mid", "_part", "_off")


def chronological(df: DataFrame, ts: str = "ts", tie: str = "record_id",
                  out: str = "seq") -> DataFrame:
    """Dense total order; untimed rows last, then full-resolution time, then file order."""
    return dense_rank_in_order(df, [F.col(ts).asc_nulls_last(), F.col(tie).asc()], out)
