"""Similarity of two names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_INTERVALS = "array<struct<s:string,t:string,v:string>>"
# In second texts of this length or more, characters above one in a hundred start no match.
LONG, SHARE = 200, 100


def _cut(c: Column, start, length=None) -> Column:
    """Characters from ``start`` (0-based) on, ``length`` of them or all."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substr(c, start + 1, F.length(c) if length is None else length)


def _alike(s: Column, t: Column, last: bool) -> Column:
    """How many first (or last) characters of two texts are equal."""
    n = F.least(F.length(s), F.length(t))
    spot = (lambda c, k: _cut(c, F.length(c) - k, F.lit(1))) if last else (lambda c, k: _cut(c, k - 1, F.lit(1)))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0),
                       lambda r, k: F.when((r == k - 1) & (spot(s, k) == spot(t, k)), k).otherwise(r))


def _longest(s: Column, v: Column) -> Column:
    """(size, -start) of the longest piece of ``s`` that ``v`` holds, the first of several."""
    def reach(i):
        return F.aggregate(F.sequence(F.lit(1), F.length(s) - i), F.lit(0), lambda r, n: F.when(
            r == n - 1, F.when(F.instr(v, _cut(s, i, n)) > 0, n).otherwise(r)).otherwise(r))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda i: F.struct(
        reach(i).alias("n"), (-i).alias("i"))))


def matching_ratio(a: Column, b: Column) -> Column:
    """2·M/T over the matching blocks: the longest common piece, then the same on both its sides.

    Open intervals wait on a stack, as the texts between blocks. ``v`` is the second text with frequent
    characters blanked out; they start no block, but a block grows over them.
    """
    seen = F.array_distinct(F.split(b, ""))
    often = F.filter(seen, lambda c: (c != "") & (F.length(b) - F.length(F.replace(b, c, F.lit("")))
                                                  > F.floor(F.length(b) / SHARE) + 1))
    often = F.when(F.length(b) >= LONG, often).otherwise(F.array().cast("array<string>"))
    blanked = F.aggregate(often, b, lambda t, c: F.replace(t, c, F.lit("\x01")))
    start = F.struct(F.array(F.struct(a.alias("s"), b.alias("t"), blanked.alias("v"))).cast(_INTERVALS).alias("open"),
                     F.lit(0).alias("m"))

    def let(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(acc, _):
        def split(x):
            s, t, v = x["s"], x["t"], x["v"]

            def grown(best):
                j = F.when(best["n"] > 0, F.instr(v, _cut(s, -best["i"], best["n"])) - 1).otherwise(0)
                i = F.when(best["n"] > 0, -best["i"]).otherwise(0)
                left = F.when(t != v, _alike(F.substr(s, F.lit(1), i), F.substr(t, F.lit(1), j), True)).otherwise(0)
                right = F.when(t != v, _alike(_cut(s, i + best["n"]), _cut(t, j + best["n"]), False)).otherwise(0)
                return F.struct((i - left).alias("i"), (j - left).alias("j"), (best["n"] + left + right).alias("n"))

            def parts(g):
                rest = F.array(
                    F.struct(F.substr(s, F.lit(1), g["i"]).alias("s"), F.substr(t, F.lit(1), g["j"]).alias("t"),
                             F.substr(v, F.lit(1), g["j"]).alias("v")),
                    F.struct(_cut(s, g["i"] + g["n"]).alias("s"), _cut(t, g["j"] + g["n"]).alias("t"),
                             _cut(v, g["j"] + g["n"]).alias("v")))
                kept = F.filter(rest, lambda y: (y["s"] != "") & (y["t"] != "") & (g["n"] > 0)).cast(_INTERVALS)
                return F.struct(F.concat(F.slice(acc["open"], 2, F.size(acc["open"])), kept).alias("open"),
                                (acc["m"] + g["n"]).alias("m"))
            return let(let(_longest(s, v), grown), parts)
        return F.when(F.size(acc["open"]) > 0, let(F.element_at(acc["open"], 1), split)).otherwise(acc)

    most = F.least(F.length(a), F.length(b)) * 2 + 1
    return F.when((a != "") & (b != ""), F.aggregate(F.sequence(F.lit(1), most), start, step)["m"] * 2.0
                  / (F.length(a) + F.length(b)))


def name_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Similarity of each distinct unequal pair of lower-cased names.

    A pair is compared once however many rows carry it, equal names never.
    """
    pairs = (df.filter(f"{a} <> '' AND {b} <> ''")
             .select(F.lower(a).alias("_a"), F.lower(b).alias("_b"))
             .filter("_a <> _b").distinct())
    return pairs.withColumn("_sim", matching_ratio(F.col("_a"), F.col("_b")))


def with_name_similarity(df: DataFrame, a: str = "document_name", b: str = "full_name",
                         out: str = "name_similarity", pairs: DataFrame | None = None) -> DataFrame:
    """2·M/T of the matching blocks; 1.0 for equal names, NULL when one is missing."""
    pairs = name_pairs(df, a, b) if pairs is None else pairs
    d = df.withColumn("_a", F.lower(a)).withColumn("_b", F.lower(b))
    d = d.join(pairs, ["_a", "_b"], "left")
    both = (F.col("_a") != "") & (F.col("_b") != "")
    return d.withColumn(out, F.when(both & (F.col("_a") == F.col("_b")), F.lit(1.0))
                        .when(both, F.col("_sim"))).select(*df.columns, out)


def name_mismatches(df: DataFrame, below: float, a: str = "document_name", b: str = "full_name") -> DataFrame:
    """(seq, name_similarity) of the rows whose names are less similar than ``below``.

    Narrow rows only: the join on the names never moves the other columns of an attempt.
    """
    d = df.select("seq", F.lower(a).alias("_a"), F.lower(b).alias("_b")).filter(
        "_a <> '' AND _b <> '' AND _a <> _b")
    low = name_pairs(df, a, b).filter(F.col("_sim") < below)
    return d.join(low, ["_a", "_b"]).select("seq", F.col("_sim").alias("name_similarity"))
