"""Language identification with one bit-sliced Bloom filter for all languages.

The filter is a table of masks, one bit for each language in as many 64-bit words as that takes. A character n-gram sets its language's
bit at a few hashed places; the AND of those places gives all languages that hold the n-gram at once.
Set bits are counted for each language, counts are corrected for the share of bits that are set by chance,
and the largest corrected count decides. The score is the share of the text's own n-grams that this language
explains, whatever the other languages and their number.

Cases: texts that are NULL or have no letter are ``und`` with score 0, and so is every text when nothing
was learned; equal counts go to the alphabetically first language; rows without a language or text teach
nothing; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.llm.common import per_text

UNKNOWN = "und"
PIECE = 1 << 20                     # characters handled at once; pieces overlap so that no n-gram is lost
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xBF58476D1CE4E5B9)


class LanguageFilter(NamedTuple):
    languages: tuple[str, ...]
    masks: np.ndarray               # 2**bits masks of ceil(languages / 64) words
    bits: int
    hashes: int
    orders: tuple[int, ...]
    letters: np.ndarray             # per code point: is it a letter
    chance: np.ndarray              # per language: share of unseen n-grams that look seen


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_hashes(text: str, letters: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all n-grams of each order in lower-cased words, with one blank around each word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.concatenate(([32], np.where(letters[codes], codes, 32), [32])).astype(np.uint64)
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])        # one blank between words
    codes, blank = codes[keep], blank[keep]
    out = []
    with np.errstate(over="ignore"):
        for n in orders:
            count = len(codes) - n + 1
            if count <= 0:
                out.append(np.empty(0, np.uint64))
                continue
            h = np.full(count, n, dtype=np.uint64)
            inner = np.zeros(count, dtype=bool)     # a blank strictly inside joins two words: not an n-gram
            for k in range(n):
                h = (h ^ codes[k:k + count]) * ODD
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    inner |= blank[k:k + count]
            out.append(h[~inner])
    return out


def pieces(text: str, overlap: int):
    """The whole text in bounded pieces that end at blanks where there is one."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        if stop < len(text):
            cut = max(text.rfind(" ", start + 1, stop), text.rfind("\n", start + 1, stop))
            stop = cut if cut > start else stop
        yield text[start:stop]
        start = stop


def places(h: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        step = (h * MIX) | np.uint64(1)
        return [((h + np.uint64(k) * step) * MIX >> np.uint64(64 - bits)).astype(np.int64) for k in range(hashes)]


def build_filter(grams: dict[str, np.ndarray], bits: int, hashes: int, orders: tuple[int, ...]) -> LanguageFilter:
    languages = tuple(sorted(grams))
    masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    for i, name in enumerate(languages):
        for p in places(grams[name], bits, hashes):
            masks[p, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    full = np.array([float(np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)))
                     for i in range(len(languages))])
    return LanguageFilter(languages, masks, bits, hashes, orders, letter_table(), full ** hashes)


def language_counts(text: str, f: LanguageFilter) -> tuple[int, np.ndarray]:
    """N-grams of the whole text, and for each language how many of them its bit is set for."""
    total, counts = 0, np.zeros(len(f.languages), dtype=np.int64)
    for piece in pieces(text, max(f.orders)):
        h = np.concatenate(gram_hashes(piece, f.letters, f.orders))
        if not len(h):
            continue
        seen = f.masks[places(h, f.bits, f.hashes)[0]]
        for p in places(h, f.bits, f.hashes)[1:]:
            seen &= f.masks[p]
        total += len(h)
        counts += np.array([np.count_nonzero(seen[:, i // 64] & (np.uint64(1) << np.uint64(i % 64)))
                            for i in range(len(f.languages))], dtype=np.int64)
    return total, counts


def decide(text: str | None, f: LanguageFilter) -> tuple[str, float]:
    if not text or not f.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    total, counts = language_counts(text, f)
    if not total:
        return UNKNOWN, 0.0
    true = np.clip((counts - total * f.chance) / np.maximum(1e-9, 1 - f.chance), 0, None)
    best = int(np.argmax(true))
    if true[best] <= 0:                         # nothing known in it: the least surprising guess, no confidence
        return f.languages[int(np.argmax(counts))], 0.0
    return f.languages[best], float(min(1.0, true[best] / total))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          documents_per_language: int = 2_000, grams_per_language: int = 30_000, min_share: float = 0.01, min_ratio: float = 0.2,
          orders: tuple[int, ...] = (3, 4, 5), bits: int = 20, hashes: int = 3) -> LanguageFilter:
    """Fit on a bounded sample: at most ``documents_per_language`` labelled rows of each language.

    The sample is drawn by a hash of the key. N-grams found in at least ``min_share`` of a language's sampled
    texts, the most widespread ``grams_per_language`` of them, enter the filter unless another language has them
    more than ``1 / min_ratio`` times as often; what reaches the driver is
    bounded by these parameters and the number of languages.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"),
                           F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("r")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return build_filter({}, bits, hashes, orders)
    letters = labelled.sparkSession.sparkContext.broadcast(letter_table())

    def grams_of(batches):
        import pyarrow as pa

        found: dict[tuple[str, int], int] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[name] = texts.get(name, 0) + 1
                h = np.concatenate([g for p in pieces(t, max(orders))
                                    for g in gram_hashes(p, letters.value, orders)] or [np.empty(0, np.uint64)])
                for g in np.unique(h).view(np.int64).tolist():
                    found[(name, g)] = found.get((name, g), 0) + 1
        if texts:
            yield pa.RecordBatch.from_arrays([
                pa.array([*(k[0] for k in found), *texts], pa.string()),
                pa.array([*(k[1] for k in found), *([None] * len(texts))], pa.int64()),
                pa.array([*found.values(), *texts.values()], pa.int64())], names=["lang", "gram", "n"])

    # Hash order: the same documents whatever the partitions. A threshold keeps each language's sort small; the
    # list of thresholds has one row a language, and all languages are counted in the same job.
    limits = []
    for name, size in sorted(sizes.items()):
        share = min(1.0, 1.5 * documents_per_language / size)
        limits.append((name, min(2 ** 63 - 1, -(2 ** 63) + int(share * 2 ** 64)), min(documents_per_language, size)))
    limits = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, low long, texts long"))
    sample = (rows.join(limits, "lang").filter(F.col("r") <= F.col("low"))
              .withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("r")))
              .filter(F.col("_k") <= documents_per_language))
    counts = (sample.select("lang", "text").repartition(8 * len(sizes)).mapInArrow(grams_of, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = (counts.join(limits, "lang").filter(F.col("gram").isNotNull() & (F.col("n") >= F.greatest(F.lit(1.0), min_share * F.col("texts"))))
           .withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
           .filter(F.col("_k") <= grams_per_language).select("lang", "gram", "n", "texts").toPandas())
    grams = {name: np.empty(0, np.uint64) for name in sorted(sizes)}
    shares = {name: np.empty(0) for name in sorted(sizes)}
    for name, part in top.groupby("lang"):
        part = part.sort_values(["n", "gram"], ascending=[False, True])
        grams[name] = part["gram"].to_numpy(dtype=np.int64).view(np.uint64)
        shares[name] = part["n"].to_numpy(dtype=float) / part["texts"].to_numpy(dtype=float)
    if grams:                                   # quotations carry n-grams of one language into another's texts
        known, at = np.unique(np.concatenate([grams[n] for n in grams]), return_inverse=True)
        most = np.zeros(len(known))
        np.maximum.at(most, at, np.concatenate([shares[n] for n in grams]))
        for n in grams:
            grams[n] = grams[n][shares[n] >= min_ratio * most[np.searchsorted(known, grams[n])]]
    return build_filter(grams, bits, hashes, orders)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row (carried columns as struct ``doc``) with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))         # plain data: workers need no copy of this package

    def answer(texts):
        f = LanguageFilter(*shared.value)
        return [decide(t, f) for t in texts]

    return per_text(docs, text, carry or ["doc_id"], answer, "lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
