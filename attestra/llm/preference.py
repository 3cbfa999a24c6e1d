"""Document quality by Bradley-Terry ranking.

A document's strength is a weighted sum of its features. In a preference pair, one text marked 1 and one marked 0, the first
is preferred with probability ``sigmoid(strength(first) - strength(second))``, so the weights follow from logistic
loss on feature *differences*; what all texts have in common, their length or language mix, cancels. Strengths have no zero point of their own.
The threshold is a quantile of the strengths of all labelled rows: the share of label 0. A score of 0.7 stands exactly there; the slope is
fitted by logistic loss.

Features describe a text as a whole, in any language: shares of character classes, word and line statistics, repetition,
and the shares of 256 hashed word shapes (runs of character classes). Nothing else about a document is an input.

Every labelled row takes part in the fit, in some pairs each: rows meet in groups of bounded size, and Newton steps, moments, threshold and
slope are sums or running counts over all of them. Every text is scored whole, in pieces.

Cases: NULL and empty texts have zeros as features and get a score; labels other than 0 and 1 and NULL labels teach nothing; a key
with several labels has their majority, 1 if equal; repeated keys among documents teach once, by the smallest text
hash; equal texts have equal scores. Without pairs (no labels, or one label only) every score is the share of label 1, 0.5 without
labels. Other columns are not read; carried ones come back inside the struct ``doc``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attestra.llm.common import per_text, text_key
from attestra.operators.ordering import dense_rank_in_order
from attestra.session import durable

PIECE = 1 << 20
SHAPES = 256
CHUNKS = 16                         # parts that sums over all rows are added up in
GROUP = 1_000                       # rows of the larger class that meet in a group
PARTNERS = 64                       # rows of the smaller class that a group has about at least
GRAMS = 1 << 14                     # cells that word pairs are counted in, for repetition
MARKS = ".,;:!?'\"()-"
CLASSES = 8                         # blank, lower, upper, digit, mark, other symbol, other letter, line end


class Ranking(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    share: float                    # of label 1 among labelled rows


def class_table() -> np.ndarray:
    """Character class by code point; code points from 0x300 on count as other letters."""
    table = np.full(0x301, 6, dtype=np.uint8)
    for i in range(0x300):
        c = chr(i)
        table[i] = (7 if c == "\n" else 0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit()
                    else 4 if c in MARKS else 6 if c.isalpha() else 5)
    return table


def tallies(text: str, table: np.ndarray) -> dict:
    """Whole-text counts, added up over pieces that end at blanks where there is one."""
    out = {"chars": np.zeros(CLASSES), "shapes": np.zeros(SHAPES), "words": 0, "letters": 0, "caps": 0, "title": 0, "bare": 0,
           "marked": 0, "short": 0, "square": 0, "pairs": np.zeros(GRAMS), "singles": np.zeros(GRAMS), "edges": 0}
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        if stop < len(text):
            cut = max(text.rfind(" ", start + 1, stop), text.rfind("\n", start + 1, stop))
            stop = cut if cut > start else stop
        _add(out, text[start:stop], table)
        start = stop
    return out


def _add(out: dict, text: str, table: np.ndarray) -> None:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = table[np.minimum(codes, 0x300)]
    out["chars"] += np.bincount(kind, minlength=CLASSES)
    blank = (kind == 0) | (kind == 7)
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    n = len(first)
    if not n:
        return
    size = last - first
    out["words"] += n
    out["letters"] += int(size.sum())
    out["square"] += int((size * size).sum())
    out["short"] += int((size <= 2).sum())
    # per word: counts of lower and upper case letters and of symbols
    def inside(mask):
        upto = np.concatenate(([0], np.cumsum(mask)))
        return upto[last] - upto[first]

    lower, upper, letters = inside(kind == 1), inside(kind == 2), inside((kind == 1) | (kind == 2) | (kind == 6))
    symbols = inside(kind == 5)
    out["caps"] += int(((upper >= 2) & (lower == 0)).sum())
    out["title"] += int(((kind[first] == 2) & (lower > 0)).sum())
    out["bare"] += int((letters == 0).sum())
    out["marked"] += int((symbols > 0).sum())
    out["edges"] += int((np.diff(kind) != 0).sum())
    # shape: the classes of the word's runs, hashed
    run = np.concatenate(([True], kind[1:] != kind[:-1]))
    run[first] = True
    at = np.nonzero(run & ~blank)[0]
    word = np.searchsorted(first, at, "right") - 1
    place = np.arange(len(at)) - np.searchsorted(word, np.arange(n))[word]
    with np.errstate(over="ignore"):
        step = np.power(np.uint64(1_000_003), np.minimum(place, 12).astype(np.uint64))
        shape = np.zeros(n, dtype=np.uint64)
        np.add.at(shape, word, (kind[at].astype(np.uint64) + np.uint64(1)) * step)
        out["shapes"] += np.bincount((shape * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64), minlength=SHAPES)
        # word hashes for repetition: a polynomial over the code points
        upto = np.concatenate(([np.uint64(0)], np.cumsum(codes.astype(np.uint64) * np.power(
            np.uint64(6364136223846793005), np.arange(len(codes), dtype=np.uint64)))))
        back = np.power(np.uint64(_inverse(6364136223846793005)), first.astype(np.uint64))
        name = (upto[last] - upto[first]) * back
        single = (name * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)
        pair = ((name[:-1] * np.uint64(31) + name[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)
    out["singles"] += np.bincount(single, minlength=GRAMS)
    out["pairs"] += np.bincount(pair, minlength=GRAMS)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


NAMES = [*(f"char{i}" for i in range(CLASSES)), "length", "mean_word", "spread_word", "short", "caps", "title", "bare", "marked",
         "edges", "words_a_line", "variety", "pair_variety", "common", "common_pair", *(f"shape{i}" for i in range(SHAPES))]


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """The feature vector of a whole text, in the order of ``NAMES``."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    t = tallies(text, table)
    out[:CLASSES] = t["chars"] / len(text)
    n = t["words"]
    if not n:
        return out
    mean = t["letters"] / n
    # different cells, against those that as many different words would fill
    full = GRAMS * -np.expm1(-n / GRAMS)
    out[CLASSES:-SHAPES] = [
        np.log1p(n), mean, np.sqrt(max(0.0, t["square"] / n - mean * mean)), t["short"] / n, t["caps"] / n, t["title"] / n,
        t["bare"] / n, t["marked"] / n, t["edges"] / len(text), np.log1p(n / (t["chars"][7] + 1)),
        np.count_nonzero(t["singles"]) / full, np.count_nonzero(t["pairs"]) / full, t["singles"].max() / n, t["pairs"].max() / n]
    out[-SHAPES:] = np.sqrt(t["shapes"] / n)
    return out


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sigmoid(z):
    return 0.5 * (1 + np.tanh(np.asarray(z) / 2))


def pairs(good: int, bad: int, per_row: int) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs: every row of the larger class meets ``per_row`` rows of the other, all rows take part."""
    r = np.random.default_rng(7)
    most = max(good, bad)
    a = np.concatenate([np.resize(r.permutation(good), most) for _ in range(per_row)])
    b = np.concatenate([np.resize(r.permutation(bad), most) for _ in range(per_row)])
    return a, b


def measures(differences: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss on differences, its gradient and its second derivatives, summed over the rows."""
    margin = differences @ w
    p = sigmoid(-margin)
    return (float(np.logaddexp(0, -margin).sum()), -differences.T @ p,
            (differences * (p * (1 - p))[:, None]).T @ differences)


def newton(measure, size: int, penalty: float, rounds: int) -> np.ndarray:
    """Weights of least mean loss plus ``penalty`` times their squares; ``measure(w)`` gives loss, gradient and curvature as means."""
    w = np.zeros(size)

    def at(w):
        loss, slope, curve = measure(w)
        return loss + penalty * w @ w, slope + 2 * penalty * w, curve + 2 * penalty * np.eye(size)

    now = at(w)
    for _ in range(rounds):
        step, part = np.linalg.solve(now[2], now[1]), 1.0
        after = at(w - step)
        while part > 1e-6 and after[0] > now[0]:
            part /= 2
            after = at(w - part * step)
        w, before, now = w - part * step, now[0], after
        if before - now[0] < 1e-9:
            break
    return w


def fit_strength(differences: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of least mean logistic loss on differences plus ``penalty`` times their squares, by Newton steps."""
    return newton(lambda w: tuple(m / len(differences) for m in measures(differences, w)), differences.shape[1], penalty, rounds)


def quantile(values: np.ndarray, weights: np.ndarray, level: float) -> float:
    """Where ``level`` of the weight lies below: midway between the neighbours there."""
    order = np.argsort(values, kind="stable")
    v, upto = values[order], np.cumsum(weights[order]) / weights.sum()
    at = int(np.searchsorted(upto, level - 1e-9))
    return float((v[min(at, len(v) - 1)] + v[min(at + 1, len(v) - 1)]) / 2)


AT_THRESHOLD = float(np.log(0.7 / 0.3))


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> tuple[DataFrame, float]:
    """(k, y, text) of all labelled documents, one row for each key, and the share of label 1 among the labelled keys."""
    marks = (labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y"))
             .filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).filter("k IS NOT NULL")
    first = texts.join(marks, "k").groupBy("k", "y").agg(F.min_by("t", F.struct(text_key(F.col("t")), "t")).alias("text"))
    return first, sizes.get(1, 0) / total if total else 0.5


def summed(rows: DataFrame, answer, size: int) -> np.ndarray:
    """The sum of ``answer(batch)``, vectors of ``size`` numbers, over all batches. It is added up on the cluster in chunks, so what
    reaches the driver does not grow with the partitions."""
    schema = "chunk int, part int, sums binary"

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += answer(batch)
        parts, at = np.array_split(total, CHUNKS), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([at] * CHUNKS, pa.int32()),
             pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "part", "sums"])

    def add(batches):
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total[c] = total.get(c, 0) + np.frombuffer(blob)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()),
             pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "part", "sums"])

    parts = rows.mapInArrow(local, schema).repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(add, schema)
    found = {r["chunk"]: np.frombuffer(r["sums"]) for r in parts.collect()}
    return np.concatenate([found[c] for c in range(CHUNKS)]) if found else np.zeros(size)


def vectors(column) -> np.ndarray:
    """The feature vectors of a binary column, one a row."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(NAMES))


def opponents(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Labelled rows in groups of about ``GROUP`` rows of the larger class; pairs are made inside a group.

    Each row of the larger class is in one group. Rows of the other class are in as many as it takes for some
    ``PARTNERS`` in each group, in all of them if there are not enough.
    """
    large = max(sizes, key=sizes.get)
    groups = -(-sizes[large] // GROUP)
    copies = min(groups, -(-PARTNERS * groups // sizes[1 - large]))
    own = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("ranking")), F.lit(groups))
    where = F.when(F.col("y") == large, F.array(own)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(own + i, F.lit(groups))))
    return rows.select("y", "x", F.explode(where).alias("g")).groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("y", "x"))).alias("rows")).select("rows")


def at_places(values: DataFrame, places: list[int]) -> list[float]:
    """The numbers ``s`` that stand at some places of their order, from 0."""
    placed = dense_rank_in_order(values, [F.col("s").asc()], "at")
    found = {r["at"]: r["s"] for r in placed.filter(F.col("at").isin(places)).collect()}
    return [found[p] for p in places]


def level_of(strengths: DataFrame, sizes: dict[int, int], share: float) -> float:
    """:func:`quantile` of all strengths (y, s) at the share of label 0, from two running counts along their order."""
    ones = 1 << 32
    placed = dense_rank_in_order(strengths, [F.col("s").asc(), F.col("y").asc()], "before", F.col("y").cast("long") * ones + 1)
    good, n = F.floor(F.col("before") / ones) + F.col("y"), F.col("before") % ones + 1
    upto = share * good / sizes[1] + (1 - share) * (n - good) / sizes[0]
    placed = durable(placed.select("s", (n - 1).alias("at"), upto.alias("upto")), "strengths")
    last = sizes[0] + sizes[1] - 1
    at = placed.filter(F.col("upto") >= 1 - share - 1e-9).agg(F.min("at")).first()[0]
    at = last if at is None else at
    near = {r["at"]: r["s"] for r in placed.filter(F.col("at").isin(at, min(at + 1, last))).collect()}
    return (near[at] + near[min(at + 1, last)]) / 2


def slope_of(strengths: DataFrame, sizes: dict[int, int], share: float, threshold: float) -> float:
    """Slope of a logistic curve that is 0.7 at the threshold; steep ones are limited so that scores stay apart."""
    place = 0.95 * (sizes[0] + sizes[1] - 1)
    low, high = at_places(strengths.select(F.abs(F.col("s") - threshold).alias("s")), [int(place), int(np.ceil(place))])
    tries = 12.0 / max(1e-9, low + (high - low) * (place - int(place))) * np.geomspace(1e-3, 1, 200)
    weight = {1: share / sizes[1], 0: (1 - share) / sizes[0]}

    def losses(batch):
        y, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        each = np.logaddexp(0, np.where(y > 0, -1, 1) * (AT_THRESHOLD + tries[:, None] * (s - threshold)))
        return (each * np.where(y > 0, weight[1], weight[0])).sum(axis=1)

    return float(tries[int(np.argmin(summed(strengths, losses, len(tries))))])


def fit(rows: DataFrame, sizes: dict[int, int], share: float, penalty: float = 1e-3, pairs_per_row: int = 4,
        rounds: int = 30) -> Ranking:
    """Ranking from the features ``x`` and labels ``y`` of all rows; ``share`` of label 1 among all labelled keys."""
    d = len(NAMES)
    if not sizes.get(0) or not sizes.get(1):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.0, share)
    n = sizes[0] + sizes[1]
    narrow = rows.select("y", "x")
    mean = summed(narrow, lambda batch: vectors(batch.column(1)).sum(axis=0), d) / n
    spread = np.sqrt(summed(narrow, lambda batch: ((vectors(batch.column(1)) - mean) ** 2).sum(axis=0), d) / n)
    scale = np.where(spread > 1e-9, spread, 1.0)
    met = durable(opponents(rows, sizes), "opponents")

    def measure(w):
        def answer(batch):
            out = np.zeros(2 + d + d * d)
            for group in batch.column(0):
                found = group.values
                y, x = np.asarray(found.field("y")), vectors(found.field("x"))
                z = np.clip((x - mean) / scale, -8, 8)
                good, bad = z[y > 0], z[y == 0]
                if len(good) and len(bad):
                    a, b = pairs(len(good), len(bad), pairs_per_row)
                    loss, slope, curve = measures(good[a] - bad[b], w)
                    out += np.concatenate([[len(a), loss], slope, curve.ravel()])
            return out

        got = summed(met, answer, 2 + d + d * d)
        return got[1] / got[0], got[2:2 + d] / got[0], got[2 + d:].reshape(d, d) / got[0]

    weights = newton(measure, d, penalty, rounds)

    def strength(batches):
        import pyarrow as pa

        for batch in batches:
            z = np.clip((vectors(batch.column(1)) - mean) / scale, -8, 8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float((row * weights).sum()) for row in z], pa.float64())], names=["y", "s"])

    strengths = durable(narrow.mapInArrow(strength, "y int, s double"), "strengths")
    threshold = level_of(strengths, sizes, share)
    return Ranking(mean, scale, weights, threshold, slope_of(strengths, sizes, share, threshold), share)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Ranking:
    """Fit on documents and the labels that point to them; give only labels that may be learned from."""
    rows, share = labelled(docs, labels, text, key, label)

    def answer(texts):
        table = class_table()
        return [(features(t, table).tobytes(),) for t in texts]

    rows = durable(per_text(rows, "text", ["k", "y"], answer, "x binary").select("doc.k", "doc.y", "x"), "features")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return fit(rows, sizes, share)


def rank(docs: DataFrame, model: Ranking, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row (carried columns as struct ``doc``) with ``score`` and ``predicted`` (1 from 0.7 on)."""
    plain = tuple(model)

    def answer(texts):
        table = class_table()
        mean, scale, weights, threshold, slope, share = plain
        if not slope:
            return [(share,)] * len(texts)
        x = np.array([features(t, table) for t in texts])
        z = np.clip((x - mean) / scale, -8, 8)
        # row by row: a matrix product may round the same row differently in different slices
        strength = [float((row * weights).sum()) for row in z]
        return [(float(s),) for s in sigmoid(AT_THRESHOLD + slope * (np.array(strength) - threshold))]

    scored = per_text(docs, text, carry or ["doc_id"], answer, "score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
