"""Finding hot keys and cutting their rows into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from attestra.policy import Skew
from attestra.session import durable

_BUCKETS = 4096         # values are counted together by hash first
_SPREAD = 4096          # rows without a key go to slots of this many places of the order


def hot_values(df: DataFrame, keys: Iterable[str], skew: Skew,
               total: int | None = None) -> dict[str, DataFrame | None]:
    """For each key column the values with more rows than the skew limit, or None.

    One pass over the data for all columns counts buckets of values; only values of buckets over the limit are
    counted one by one. A list of at most ``Skew.broadcast_values`` carries a broadcast hint; a longer one is
    joined like any other table.
    """
    keys = list(keys)
    total = df.count() if total is None else total
    limit = skew.hot_rows
    if total <= limit:
        return dict.fromkeys(keys)
    def bucket(v: Column) -> Column:
        return F.when(v.isNotNull(), F.pmod(F.xxhash64(v), F.lit(_BUCKETS)).cast("int"))

    text = {k: F.col(k).cast("string") for k in keys}
    crowded = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), bucket(text[k]).alias("b")) for i, k in enumerate(keys)
    ])).alias("e")).select("e.i", "e.b").filter("b IS NOT NULL").groupBy("i", "b").count()
    crowded = durable(crowded.filter(F.col("count") > limit).select("i", "b"), "crowded")
    if crowded.isEmpty():
        return dict.fromkeys(keys)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), text[k].alias("v")) for i, k in enumerate(keys)
    ])).alias("e")).select("e.*").filter("v IS NOT NULL").withColumn("b", bucket(F.col("v")))
    found = durable(long.join(F.broadcast(crowded), ["i", "b"]).groupBy("k", "v").count()
                    .filter(F.col("count") > limit), "hot")
    out: dict[str, DataFrame | None] = {}
    for k in keys:
        one = found.filter(F.col("k") == k).select(F.col("v").cast(df.schema[k].dataType).alias(k))
        n = one.count()
        one = one.withColumn("_hot", F.lit(True))
        out[k] = None if n == 0 else F.broadcast(one) if n <= skew.broadcast_values else one
    return out


def slotted(df: DataFrame, key: str, hot: DataFrame | None, skew: Skew,
            missing: Column | None = None) -> DataFrame:
    """Add ``_hot`` and ``_slot``; (key, _slot) is the unit of work of one window group.

    Cold keys keep one slot, hot keys get one slot per block of the total order, and rows whose
    key is missing (they need no history) are spread over small slots so that NULL is never a hot key.
    """
    missing = F.col(key).isNull() if missing is None else missing
    if hot is None:
        df = df.withColumn("_hot", F.lit(False))
    else:
        df = df.join(hot, key, "left") \
               .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return df.withColumn("_slot", F.when(missing, F.floor(F.col("seq") / min(skew.block_rows, _SPREAD)))
                         .when(F.col("_hot"), F.floor(F.col("seq") / skew.block_rows))
                         .otherwise(F.lit(0)).cast("long"))
