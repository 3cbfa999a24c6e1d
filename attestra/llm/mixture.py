"""Temperature mixing: source weights by one exponent, realised as blocks of whole documents.

Weights are token shares to the power of an exponent between 0 (all sources alike) and 1 (as they are),
normalised. Bisection finds the largest exponent whose entropy meets the target, raised where some source
would otherwise be repeated too often. Each source then gets its share of the token budget: whole passes
over its documents, each in a fresh permutation, and the beginning of one more. Passes are laid out in
blocks that all have the same mixture, and each block is permuted. DataFrame functions only.

Running token sums never see a whole source in one task: a permutation is cut into buckets of hash order,
bucket totals are summed first, and only they are added up over the source.

Cases: NULL sources form one source of that name; documents without words are never placed; NULL ids are
told apart by their texts; repeated rows are placed as separate documents; an empty table gives an empty
result; one source gets the whole budget; a budget is never exceeded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.llm.quality import words
from attestra.session import durable

STEPS = 8                                       # rounds of bisection; each settles four binary digits


def _curve(a: float) -> list[Column]:
    p = F.col("p")
    return [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1.0)))]


def _entropy(z: float, l: float, a: float) -> float:
    return math.log(z) - a * l / z


def exponent(shares: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float) -> float:
    """Exponent for the shares ``p``: each job evaluates the 15 midpoints of the next four halvings."""
    n = shares.count()
    if n < 2:
        return 1.0
    target = target_entropy * math.log(n)
    ends = shares.agg(*_curve(0.0), *_curve(1.0)).first()
    repeats = lambda z, m: budget_ratio * m / z
    low, high = [0.0, 0.0], [1.0, 1.0]          # of the entropy search and of the repetition search
    if _entropy(ends[3], ends[4], 1.0) >= target:
        low[0] = high[0] = 1.0
    if repeats(ends[0], ends[2]) <= max_repeats:
        low[1] = high[1] = 0.0
    elif repeats(ends[3], ends[5]) > max_repeats:
        low[1] = high[1] = 1.0
    for _ in range(STEPS):
        points = [[lo + (hi - lo) * k / 16 for k in range(1, 16)] for lo, hi in zip(low, high)]
        got = shares.agg(*[c for side in points for a in side for c in _curve(a)]).first()
        at = lambda side, k: got[45 * side + 3 * k:45 * side + 3 * k + 3]
        for side in (0, 1):
            if low[side] == high[side]:
                continue
            grid = [low[side], *points[side], high[side]]
            meets = [_entropy(at(0, k)[0], at(0, k)[1], a) >= target for k, a in enumerate(points[0])] if side == 0 \
                else [repeats(at(1, k)[0], at(1, k)[2]) > max_repeats for k in range(15)]
            last = max((k + 1 for k, ok in enumerate(meets) if ok), default=0)
            low[side], high[side] = grid[last], grid[last + 1]
    return max(low[0], high[1])


def source_weights(rows: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float,
                   budget: int | None = None) -> DataFrame:
    """(source, tokens, documents, ppb, quota): weights in parts per 10**9 and token quotas."""
    sources = durable(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")),
                      "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total * budget_ratio) if budget is None else budget
    shares = sources.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    a = exponent(shares, target_entropy, max_repeats, budget / total if total else 1.0)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    ppb = F.floor(F.pow("p", F.lit(a)) / F.lit(z) * 1e9 + 0.5).cast("long")
    b1, b0 = F.lit(budget // 10**6), F.lit(budget % 10**6)      # the product stays within 64 bits
    quota = F.expr("cast(b1 * ppb div 1000 + b0 * ppb div 1000000000 as long)")
    return shares.select("source", "tokens", "documents", ppb.alias("ppb"), b1.alias("b1"), b0.alias("b0")) \
        .withColumn("quota", quota).drop("b1", "b0")


def permuted(seed: int, *what: Column) -> Column:
    """52 bits of MD5 as a fraction's numerator; the same in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *what).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        target_entropy: float = 0.97, max_repeats: float = 4.0, budget_ratio: float = 1.0,
        block_tokens: int = 262_144, bucket_documents: int = 2_000, seed: int = 17) -> DataFrame:
    """(key, source, copy, block, position, n_tokens): the placed documents, each pass a ``copy``.

    ``target_entropy`` is a share of the largest possible entropy; the budget is ``budget_ratio`` times
    the tokens of the input. White-space separated words count as tokens.
    """
    rows = durable(docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("NULL")).alias("source"),
        F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("name"),
        F.size(words(F.col(text))).cast("long").alias("n_tokens")).filter("n_tokens > 0"), "tokens")
    sources = durable(source_weights(rows, target_entropy, max_repeats, budget_ratio), "weights")
    budget = sources.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, -(-budget // block_tokens))
    passes = rows.join(sources, "source").select(
        "key", "source", "name", "n_tokens", "tokens", "documents", "quota",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr("quota div tokens"))).alias("copy"))
    order = permuted(seed, F.col("copy").cast("string"), F.col("name"))
    parts = F.ceil(F.col("documents") / bucket_documents)
    passes = passes.withColumn("h", order).withColumn(
        "bucket", F.floor(F.col("h") / F.lit(float(2**52)) * parts).cast("long"))
    sums = passes.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("source", "copy", "bucket", (F.coalesce(F.sum("n").over(
        W.partitionBy("source", "copy").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0))).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "copy", "bucket").orderBy("h", "name", "n_tokens")
                                    .rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = (passes.withColumn("inside", inside).join(before, ["source", "copy", "bucket"])
              .withColumn("end", F.col("copy") * F.col("tokens") + F.col("before") + F.col("inside"))
              .filter("end <= quota"))
    start = (F.col("end") - F.col("n_tokens")).cast("double")
    block = F.least(F.lit(blocks - 1), F.floor(start * F.lit(float(blocks)) / F.col("quota"))).cast("long")
    spot = permuted(seed, F.lit("block"), F.col("copy").cast("string"), F.col("name"))
    at = F.row_number().over(W.partitionBy("block").orderBy("spot", "name", "copy", "n_tokens", "end"))
    return (placed.withColumn("block", block).withColumn("spot", spot)
            .select(F.col("key").alias(key), "source", F.col("copy").cast("long").alias("copy"), "block",
                    at.cast("long").alias("position"), "n_tokens"))
