"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

Words are the symbols of the search. All windows of one length form a group. A group has a table from
blocks of two words to safe shifts; a block that ends no window moves the search on, a block that does
names the bucket of windows with that suffix, and those are compared word by word. A last word that no
window holds moves the search on by a whole window.

Cases: NULL or wordless texts have no words and are never contaminated; NULL or wordless items have no
windows; an item without id still hits words and is listed under the empty id; repeated items count
once; repeated documents are judged row by row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import lower_ascii, per_text

# A word is a run of ASCII letters, digits and anything beyond ASCII; in UTF-8 this is a rule on bytes.
_SAME = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
              for b in range(256))
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FIELDS = "n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SAME).split()


def search_tables(items: list[tuple[str, list[bytes]]], window: int = 13) -> list[tuple]:
    """(length, block size, shifts, buckets, words) for every window length found in ``items``."""
    groups: dict[int, dict[tuple, set]] = {}
    for item, words in items:
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            groups.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(item)
    tables = []
    for m, patterns in sorted(groups.items()):
        b = min(2, m)
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, list] = {}
        for p, owners in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b:end]
                shifts[block] = min(shifts.get(block, m), m - end)
            buckets.setdefault(p[m - b:], []).append((list(p), sorted(owners)))
        tables.append((m, b, shifts, buckets, frozenset(w for p in patterns for w in p)))
    return tables


def find(words: list[bytes], tables: list[tuple]) -> tuple[list[tuple[int, int]], list[str]]:
    """Word ranges (end exclusive, merged) covered by occurrences, and the items they come from."""
    found, owners = [], set()
    n = len(words)
    for m, b, shifts, buckets, known in tables:
        rest = m - b + 1                        # no block of any window: the next window may start inside it
        end = m
        while end <= n:
            if words[end - 1] not in known:
                end += m
                continue
            block = tuple(words[end - b:end])
            shift = shifts.get(block, rest)
            if shift:
                end += shift
                continue
            for pattern, items in buckets[block]:
                if words[end - m:end] == pattern:
                    found.append((end - m, end))
                    owners.update(items)
            end += 1
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged, sorted(owners)


def _scan(docs: DataFrame, text: str, carry: list[str], items: list[tuple[str, list[bytes]]],
          window: int) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(search_tables(items, window))

    def answer(texts):
        rows = []
        for t in texts:
            words = words_of(t)
            spans, owners = find(words, tables.value)
            rows.append((len(words), sum(e - s for s, e in spans),
                         [{"start": s, "end": e} for s, e in spans], owners))
        return rows

    return per_text(docs, text, carry, answer, FIELDS, raw=True)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None,
                   item: str = "item_id", item_text: str = "text", window: int = 13,
                   block_words: int = 2_000_000) -> DataFrame:
    """Every document row (as struct ``doc``) with its words, hit words, hit ranges and items.

    The search tables of at most ``block_words`` benchmark words travel to the executors at once. A larger
    benchmark is searched in several blocks of items, one pass over the documents each, and the ranges of
    a document are merged afterwards; results are the same.
    """
    carry = carry or ["doc_id"]
    size = F.size(F.filter(F.split(lower_ascii(F.coalesce(F.col("item_text"), F.lit(""))),
                                   r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                            F.col(item_text).cast("string").alias("item_text")).distinct()
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_words) or 1

    def block(b: int) -> list[tuple[str, list[bytes]]]:
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == b)
        return [(r["item"], words_of((r["item_text"] or "").encode())) for r in part.toLocalIterator()]

    if blocks == 1:
        return _scan(docs, text, carry, block(0), window)
    parts = [_scan(docs, text, carry, block(b), window) for b in range(blocks)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    key = F.xxhash64("doc").alias("k")
    at = F.array_sort(F.flatten(F.collect_list("hits")))
    merged = (merged.groupBy(key, "doc", "n_words")
              .agg(at.alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                   (F.count("*") / blocks).cast("int").alias("copies")))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["end"] - 1)))))
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc", "n_words", covered.cast("long").alias("n_hit"), "hits",
                    F.array_sort("items").alias("items")))


def contaminated(percent: int = 5) -> Column:
    """At least ``percent`` of the words are hit, and at least one is."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def digest(items: str = "items") -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
