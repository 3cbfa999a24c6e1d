"""Ranked lexical search: an Aho-Corasick scan of whole documents, without a document index.

All different terms of the items form one automaton. Its patterns are guarded: a blank, the term, a blank; everything that
is not part of a term is a blank in the scanned text, so a pattern occurs exactly where the whole term stands. An
occurrence leads to the term, the term to the items that hold it and how often.

One scan counts documents, terms and document frequencies; a second one scores. A task keeps the best documents of each
item only (a document that is not among the best of its task is not among the best of all), and ranking is done in two steps so
that no item gathers the answers of all tasks at once.

The automaton grows with the items, so items are dealt into blocks of at most ``block_terms`` pairs of item and term (or a
single item, if it has more), and each block is scanned for on its own. The driver and each Python worker hold one block.

Cases: NULL texts and texts without a term count nowhere and are never found; items without a term have no rows; repeated
documents and repeated items are rows of their own (equal items rank alike); equal scores go by ascending key, NULL keys last; empty
tables give no rows. A text is read whole, in a few copies of its own size. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from attestra.llm.common import lower_ascii
from attestra.session import durable

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_bytes() -> bytes:
    """Byte translation: A-Z to a-z, other bytes of terms stay, all else becomes a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def guarded(terms: list[str]):
    """The automaton of the terms, each between blanks; its values are positions in the list.

    Texts are scanned as bytes, each byte as the character of its number.
    """
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        a.add_word(f" {t.encode().decode('latin-1')} ", i)
    a.make_automaton()
    return a


def term_counts(text: bytes, automaton, table: bytes) -> tuple[int, Counter]:
    """All terms of a text with repeats, and how often each term of the automaton occurs."""
    plain = text.translate(table)
    n = len(plain.split())
    if not n:
        return 0, Counter()
    return n, Counter(map(itemgetter(1), automaton.iter(f" {plain.decode('latin-1')} ")))


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(uid, item, term, times) of every item that has a term; ``uid`` tells equal keys apart."""
    rows = durable(items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("string").alias("t"))
                   .withColumn("uid", F.monotonically_increasing_id()), "items")
    terms = F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(TERM), F.lit(0))
    return (rows.select("uid", "item", F.explode(terms).alias("term"))
            .groupBy("uid", "item", "term").agg(F.count("*").alias("times")))


def blocks(terms: DataFrame, block_terms: int) -> list[DataFrame]:
    """Item terms in blocks of at most ``block_terms`` rows, or of one item."""
    total = terms.count()
    n = max(1, -(-total // block_terms))
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(n)), F.lit(n)))
        worst = dealt.groupBy("block").agg(F.count("*").alias("rows"), F.min("uid").alias("a"), F.max("uid").alias("b")) \
            .filter((F.col("rows") > block_terms) & (F.col("a") < F.col("b")))
        if n == 1 or worst.isEmpty():
            return [dealt.filter(F.col("block") == i).drop("block") for i in range(n)] if total else []
        n *= 2


def _frequencies(docs: DataFrame, terms) -> DataFrame:
    """(term, n): document frequency by term position; -1 counts documents with a term, -2 all their terms."""

    def run(batches):
        import pyarrow as pa

        automaton, table = guarded(terms.value), term_bytes()
        held, length, df = 0, 0, np.zeros(len(terms.value), dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_buffer()
                n, counts = term_counts(text.to_pybytes(), automaton, table) if text is not None else (0, ())
                if n:
                    held, length = held + 1, length + n
                    df[list(counts)] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()),
                                          pa.array([held, length, *df[at].tolist()], pa.int64())], names=["term", "n"])

    return docs.select(F.col("t").cast("binary").alias("t")).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n"))


def best_of(item, score, key, missing, top: int):
    """Positions of the ``top`` best rows of every item: highest score, then smallest key, missing keys last."""
    order = np.lexsort((key, missing, -score, item))
    item = item[order]
    first = np.concatenate(([True], item[1:] != item[:-1])) if len(item) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
    return order[np.arange(len(item)) - start < top]


def _scores(docs: DataFrame, model, top: int) -> DataFrame:
    """(item, score, key): the best documents of each task for every item."""

    def run(batches):
        import pyarrow as pa

        terms, weight, start, size, owner, times, items, n_docs, n_terms = model.value
        automaton, table = guarded(terms), term_bytes()
        least = np.ones(items, dtype=np.int64)          # what a score needs to be among the best so far
        kept = [np.empty(0, np.int64)] * 4
        fresh, waiting = [], 0

        def settle(kept, fresh):
            rows = [np.concatenate(c) for c in zip(kept, *fresh)]
            at = best_of(*rows, top)
            rows = [c[at] for c in rows]
            full = np.bincount(rows[0], minlength=items) >= top
            low = np.full(items, np.iinfo(np.int64).max)
            np.minimum.at(low, rows[0], rows[1])
            return rows, np.where(full, low, 1)

        for batch in batches:
            keys = batch.column(0)
            missing = np.asarray(keys.is_null(), dtype=np.int64)
            keys = np.asarray(keys.fill_null(0), dtype=np.int64)
            for row, value in enumerate(batch.column(1)):
                text = value.as_buffer()
                n, counts = term_counts(text.to_pybytes(), automaton, table) if text is not None else (0, None)
                if not counts:
                    continue
                t = np.fromiter(counts.keys(), np.int64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                part = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))
                many = size[t]
                upto = np.cumsum(many)
                post = np.repeat(start[t] - upto + many, many) + np.arange(upto[-1])
                score = np.zeros(items, dtype=np.int64)
                np.add.at(score, owner[post], np.repeat(part, many) * times[post])
                good = np.nonzero(score >= least)[0]
                if len(good):
                    fresh.append((good, score[good], np.full(len(good), keys[row]), np.full(len(good), missing[row])))
                    waiting += len(good)
                    if waiting > 4 * top * items + 10_000:
                        (kept, least), fresh, waiting = settle(kept, fresh), [], 0
        kept, _ = settle(kept, fresh)
        for at in range(0, len(kept[0]), 65_536):
            item, score, key, gone = (c[at:at + 65_536] for c in kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(key, pa.int64(), mask=gone.astype(bool))],
                names=["item", "score", "key"])

    return docs.select("key", F.col("t").cast("binary").alias("t")).mapInArrow(run, "item long, score long, key long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text",
           item_key: str = "item_id", block_terms: int = 500_000) -> DataFrame:
    """``item``, ``rank``, ``key``, ``score`` of the ``top`` best documents of each item; keys are whole numbers.

    With N documents that hold a term, L terms in them, n in this one, and ``tf`` occurrences of a term that ``df`` documents
    hold: w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + 75nN div L, and the score adds w * (10^9 tf div (1000 tf + 8m)) over
    the item's terms, repeats included.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    found, n_docs, n_terms = None, 0, 0
    for block in blocks(durable(item_terms(items, item_text, item_key), "item-terms"), block_terms):
        rows = block.orderBy("term", "uid").toPandas()
        if rows.empty:
            continue
        terms, at = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
        ids, owner = np.unique(rows["uid"].to_numpy(), return_inverse=True)
        terms = terms.tolist()
        counts = dict(_frequencies(held, spark.sparkContext.broadcast(terms)).collect())
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_docs:
            break
        # log as Python has it, so that driver and tests agree to the last digit
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(i, 0) + 1)))
                           for i in range(len(terms))], dtype=np.int64)
        size = np.bincount(at, minlength=len(terms))
        order = np.argsort(at, kind="stable")
        model = spark.sparkContext.broadcast((
            terms, weight, np.cumsum(size) - size, size, owner[order], rows["times"].to_numpy()[order], len(ids), n_docs, n_terms))
        names = block.groupBy("uid").agg(F.first("item").alias("name"))
        place = spark.createDataFrame([(i, int(u)) for i, u in enumerate(ids)], "item long, uid long")
        best = _scores(held, model, top)
        by = [F.desc("score"), F.asc_nulls_last("key")]
        salted = W.partitionBy("item", F.pmod(F.xxhash64("key"), F.lit(32))).orderBy(*by)
        few = best.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= top).drop("r")
        ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)
        part = durable(ranked.join(place.join(names, "uid"), "item").select(
            F.col("name").alias("item"), "rank", "key", "score"), "ranks")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = items.select(F.col(f"`{item_key}`").alias("item")).schema["item"].dataType
        return spark.createDataFrame([], "rank int, key long, score long").select(
            F.lit(None).cast(kind).alias("item"), "rank", "key", "score")
    return found
