"""Embedding whitening with covariances from polarisation.

Entries become whole numbers, ``x = floor(scale * c) + offset``. With ``n`` vectors and sums ``S`` the centred
entries ``y = n * x - S`` are whole numbers too. Tasks add up exact squares of two kinds: ``y_i`` for every dimension,
and ``y_i + y_j`` for every pair of dimensions. Then

    sum(y_i * y_j) = (sum((y_i + y_j)^2) - sum(y_i^2) - sum(y_j^2)) / 2

gives every cross-covariance as a difference of variances, without rounding. The driver holds one number for each pair of
dimensions, whatever the rows, and assembles them for ``eigh``.

Three passes read the vectors: sums, squares, projection. What a task hands on is one row for each dimension or pair.

Cases: a vector that is NULL, empty, or holds NULL, NaN, infinite entries or entries of 2**37 or more in size is left
out; where lengths differ, the commonest length stays (of equally common ones the largest) and other vectors are left
out. Repeated rows and NULL ids are rows like any other. Components without variance (rank
below ``components``, a single row, equal rows) have no rows; an empty table gives none. ``deviation`` is NULL if it has more
than 38 digits. Other columns are not read; carried ones come back inside the struct ``doc``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from attestra.session import durable

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 37)            # entries of this size or more are treated as not finite
LIMB = 40                           # bits of a sum that travel in one long
LIMBS = 5
HALF = 26                           # numbers under 2**52 are squared in two halves of 26 bits
SLICE = 1024                        # rows at once: 2**10 products of 2**52 fit a long


class Moments(NamedTuple):
    n: int
    sums: list[int]
    widest: int                     # largest minus smallest x of any dimension


def whole_numbers(column, scale: int, offset: int, length: int | None):
    """(rows, matrix of x) for each vector length in an Arrow list column, or for one length only."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64())
    values = np.asarray(pc.fill_null(values, math.nan))
    starts = np.cumsum(sizes) - sizes
    bad = ~(np.abs(values) < LARGEST)
    upto = np.concatenate(([0], np.cumsum(bad)))
    fine = (sizes > 0) & (upto[starts + sizes] == upto[starts])
    for d in ([length] if length else np.unique(sizes[fine]).tolist()):
        rows = np.nonzero(fine & (sizes == d))[0]
        for at in range(0, len(rows), SLICE):
            some = rows[at:at + SLICE]
            yield some, np.floor(values[starts[some][:, None] + np.arange(d)] * scale).astype(np.int64) + offset


def limbs(values: list[int]) -> list[list[int]]:
    """Whole numbers in LIMBS parts each, low to high; the parts of many numbers can be added as longs."""
    mask = (1 << LIMB) - 1
    parts = [[(v >> (LIMB * k)) & mask for v in values] for k in range(LIMBS - 1)]
    return [*parts, [v >> (LIMB * (LIMBS - 1)) for v in values]]


def from_limbs(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares of each column; ``z`` holds longs under 2**52 in size, or Python integers."""
    if z.dtype == object:
        return list((z * z).sum(axis=0))
    high, low = z >> HALF, z & ((1 << HALF) - 1)
    hh, hl, ll = ((a * b).sum(axis=0).tolist() for a, b in ((high, high), (high, low), (low, low)))
    return [(a << (2 * HALF)) + (b << (HALF + 1)) + c for a, b, c in zip(hh, hl, ll)]


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """``n * x - S``: longs where sums of two stay under 2**52, Python integers otherwise."""
    if 2 * m.n * m.widest < 1 << 52:
        # |n * x| may pass a long although the difference does not: wrap-around of both cancels.
        s = np.array([v & (2 ** 64 - 1) for v in m.sums], dtype=np.uint64)
        with np.errstate(over="ignore"):
            return (x.astype(np.uint64) * np.uint64(m.n) - s).view(np.int64)
    return x.astype(object) * m.n - np.array(m.sums, dtype=object)


def pair_squares(y: np.ndarray) -> list[int]:
    """Sums of squares of every column, then of every sum of two columns, in the order of ``triangle``."""
    out = square_sums(y)
    for i in range(y.shape[1] - 1):
        out += square_sums(y[:, i:i + 1] + y[:, i + 1:])
    return out


def covariance(squares: list[int], d: int, n: int) -> np.ndarray:
    """The covariance of x, each entry rounded once; ``squares`` as ``pair_squares`` lists them."""
    out = np.empty((d, d))
    at = d
    for i in range(d):
        out[i, i] = squares[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n ** 3)
            at += 1
    return out


def _sums(held: DataFrame, scale: int, offset: int) -> DataFrame:
    """(d, pos, n, smallest, largest, parts of the sum) for every vector length."""

    def run(batches):
        import pyarrow as pa

        seen: dict[int, list] = {}
        for batch in batches:
            for rows, x in whole_numbers(batch.column(0), scale, offset, None):
                d = x.shape[1]
                low, high, total = x.min(axis=0), x.max(axis=0), x.sum(axis=0).tolist()
                if d in seen:
                    n, a, b, s = seen[d]
                    seen[d] = [n + len(rows), np.minimum(a, low), np.maximum(b, high), [p + q for p, q in zip(s, total)]]
                else:
                    seen[d] = [len(rows), low, high, total]
        for d, (n, low, high, total) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array([n] * d, pa.int64()),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), *(pa.array(p, pa.int64()) for p in limbs(total))],
                names=["d", "pos", "n", "low", "high", *(f"p{k}" for k in range(LIMBS))])

    fields = "d long, pos long, n long, low long, high long, " + ", ".join(f"p{k} long" for k in range(LIMBS))
    return held.select("v").mapInArrow(run, fields).groupBy("d", "pos").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(f"p{k}").alias(f"p{k}") for k in range(LIMBS)])


def moments(held: DataFrame, scale: int, offset: int, max_dimensions: int) -> Moments | None:
    """Counts and sums of the commonest vector length."""
    found = durable(_sums(held, scale, offset), "sums")
    first = found.filter("pos = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if first is None:
        return None
    if first["d"] > max_dimensions:
        raise ValueError(f"{first['d']} dimensions: the driver assembles at most max_dimensions = {max_dimensions}")
    rows = found.filter(F.col("d") == first["d"]).orderBy("pos").collect()
    return Moments(first["n"], [from_limbs(r[f"p{k}"] for k in range(LIMBS)) for r in rows],
                   max(r["high"] - r["low"] for r in rows))


def _squares(held: DataFrame, m: Moments, scale: int, offset: int) -> list[int]:
    d = len(m.sums)

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), scale, offset, d):
                part = pair_squares(centred(x, m))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        for at in range(0, len(total or []), 65_536):
            some = total[at:at + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + len(some)), pa.int64()), *(pa.array(p, pa.int64()) for p in limbs(some))],
                names=["pos", *(f"p{k}" for k in range(LIMBS))])

    rows = (held.select("v").mapInArrow(run, "pos long, " + ", ".join(f"p{k} long" for k in range(LIMBS)))
            .groupBy("pos").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(LIMBS)]).toPandas().sort_values("pos"))
    return [from_limbs(p) for p in zip(*(rows[f"p{k}"].tolist() for k in range(LIMBS)))]


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues that are not rounding noise, and their unit vectors as columns (largest entry positive)."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(components, int(np.count_nonzero(e > 16 * max(16, len(e)) * np.finfo(float).eps * max(e[0], 0.0))))
    e, u = e[:keep], u[:, :keep]
    if keep:
        u = u * np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(keep)])
    return e, u


def whiten(vectors: DataFrame, vector: str = "embedding", carry: list[str] | None = None, components: int = 8,
           scale: int = SCALE, offset: int = OFFSET, max_dimensions: int = 2048) -> DataFrame:
    """One row for each usable vector and component: ``doc``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``."""
    carry = carry or ["vec_id"]
    held = vectors.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v"))
    out = held.select("doc").schema.add("deviation", T.DecimalType(38, 0)).add("w", T.ArrayType(T.DoubleType()))
    m = moments(held, scale, offset, max_dimensions)
    if m is None:
        e, u, explained = np.empty(0), np.empty((0, 0)), []
    else:
        v = covariance(_squares(held, m, scale, offset), len(m.sums), m.n)
        e, u = principal(v, components)
        explained = (e / np.trace(v)).tolist() if len(e) else []
    if not len(e):
        empty = held.sparkSession.createDataFrame([], out)
        return empty.select("doc", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), "deviation",
                            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    project = u / np.sqrt(e)
    d, k = project.shape

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            doc = batch.column(0)
            for rows, x in whole_numbers(batch.column(1), scale, offset, d):
                y = centred(x, m)
                w = (y.astype(float) / m.n) @ project
                deviation = [Decimal(s) if s < 10 ** 38 else None for s in square_sums(y.T)]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(rows)), pa.array(deviation, pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(w.ravel()))],
                    names=["doc", "deviation", "w"])

    rows = durable(held.mapInArrow(run, out), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return rows.select("doc", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "doc", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(explained), F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
