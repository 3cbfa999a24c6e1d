"""Substring near-duplicates: shared k-mer seeds, collinear chains, aligned fuzzy passages.

Seeds are the minimizers of word 5-grams: of any 16 neighbouring 5-grams at least the one with the smallest
hash is a seed, on every text alike, so an equal passage of 51 words shares two seeds or more. A seed's
documents are joined as a star: each occurrence is matched with one occurrence in the seed's first document
(and that one with the second document), which is linear in the occurrences and still covers every passage
that occurs elsewhere. Seeds expected in very many documents are split into salted groups whose first
documents are joined once more.

Per document and partner, matches are chained in order: the best predecessor of a match under a linear gap
cost is a prefix maximum in a Fenwick tree. Chains are then aligned on the words: the gaps by edit distance,
the ends by extension. Fragments of at least the given similarity are merged over all partners, and runs of at
least ``min_words`` words are passages. Documents that share passages are components.

Cases: NULL, empty and short texts have no passages and are their own component; a passage repeated only inside
one document does not count; repeated rows count as one document and get equal answers; NULL ids take part,
and a component without any id has none; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from attestra.llm.common import text_key
from attestra.operators.graph import connected
from attestra.session import durable

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP_COST = 0.1                      # of a word of gap, against ``k`` points for a match


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def seeds_of(words: list[bytes], k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-mers that are the smallest of some ``window`` neighbours."""
    from xxhash import xxh64_intdigest

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    one = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    h = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ one[i:i + n]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    size = min(window, n)
    low, span = h, 1
    while span < size:                          # minima of windows by doubling
        step = min(span, size - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    edge = np.full(size - 1, 0, dtype=np.uint64)
    high = np.concatenate((edge, low, edge))    # largest window minimum around each position
    span = 1
    while span < size:
        step = min(span, size - span)
        high = np.maximum(high[:-step], high[step:])
        span += step
    at = np.flatnonzero(high == h)
    return h[at].view(np.int64), at.astype(np.int32)


def link_runs(seed: np.ndarray, salt: np.ndarray, n: np.ndarray, pos: np.ndarray):
    """Star matches of whole seed groups sorted by (seed, salt, n, pos), and the groups' first occurrences.

    The r-th occurrence in a document meets the partner's r-th (or last), so repeated lines stay in step.
    """
    new_seed = np.concatenate(([True], (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])))
    new_doc = new_seed | np.concatenate(([True], n[1:] != n[:-1]))
    start, docs = np.flatnonzero(new_seed), np.flatnonzero(new_doc)
    size = len(n)
    of_doc = np.cumsum(new_doc) - 1
    rank = np.arange(size) - docs[of_doc]       # occurrence of the seed within its document
    count = np.diff(np.append(docs, size))
    sizes = np.diff(np.append(start, size))
    first = np.repeat(of_doc[start], sizes)     # the group's first document, and its second or a sentinel
    has_second = np.append(~new_seed[docs], False)[first + 1]
    partner_doc = np.where(of_doc == first, first + 1, first)
    ok = (of_doc != first) | has_second
    partner = docs[partner_doc[ok]] + np.minimum(rank[ok], count[partner_doc[ok]] - 1)
    return (n[ok], pos[ok], n[partner], pos[partner]), start


def chains_of(pos: np.ndarray, apos: np.ndarray, k: int) -> list[np.ndarray]:
    """Indices of collinear chains, best first; every match belongs to one chain. Input sorted by (pos, apos)."""
    m = len(pos)
    if m == 1:
        return [np.array([0])]
    dp, da = np.diff(pos), np.diff(apos)
    if (dp > 0).all() and (da > 0).all() and (GAP_COST * (dp + da) / 2 < k).all():
        return [np.arange(m)]
    values = np.unique(apos)
    rank = (np.searchsorted(values, apos) + 1).tolist()
    best = [(-1e18, -1)] * (len(values) + 1)    # Fenwick tree of prefix maxima over partner positions
    p, a = pos.tolist(), apos.tolist()
    score, back = [0.0] * m, [-1] * m
    i = 0
    while i < m:
        j = i
        while j < m and p[j] == p[i]:           # equal positions do not precede each other
            top, r = (-1e18, -1), rank[j] - 1
            while r > 0:
                top = max(top, best[r])
                r -= r & -r
            gain = top[0] - GAP_COST * (p[j] + a[j]) / 2
            score[j], back[j] = (k + gain, top[1]) if gain > 0 else (float(k), -1)
            j += 1
        for q in range(i, j):
            item, r = (score[q] + GAP_COST * (p[q] + a[q]) / 2, q), rank[q]
            while r < len(best):
                best[r] = max(best[r], item)
                r += r & -r
        i = j
    used, out = [False] * m, []
    for end in sorted(range(m), key=lambda q: -score[q]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = back[end]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def document_chains(an: np.ndarray, pos: np.ndarray, apos: np.ndarray, k: int, window: int, min_words: int,
                    min_seeds: int) -> list[tuple[int, list[int], list[int]]]:
    """Chains of one document with all partners, but for stretches too short to hold a passage."""
    order = np.lexsort((apos, pos, an))
    an, pos, apos = an[order], pos[order], apos[order]
    start = np.flatnonzero(np.concatenate(([True], an[1:] != an[:-1])))
    chains = []
    for s, e in zip(start, np.append(start[1:], len(an))):
        chains += [(int(an[s]), pos[s:e][c], apos[s:e][c]) for c in chains_of(pos[s:e], apos[s:e], k)]
    chains.sort(key=lambda c: int(c[1][0]))
    reach = window + k                          # how far a passage may go on beyond its outermost seeds
    out, run, seeds, end = [], [], set(), None

    def close():
        if run and len(seeds) >= min_seeds and end - int(run[0][1][0]) + k + 2 * reach >= min_words:
            out.extend((a, p.tolist(), q.tolist()) for a, p, q in run)

    for c in chains:
        if end is not None and int(c[1][0]) > end + 2 * reach:
            close()
            run, seeds, end = [], set(), None
        run.append(c)
        seeds.update(c[1].tolist())
        end = max(end or 0, int(c[1][-1]))
    close()
    return out


def edits(x: list[bytes], y: list[bytes]) -> int:
    """Word edit distance of two gaps."""
    while x and y and x[0] == y[0]:
        x, y = x[1:], y[1:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if not x or not y:
        return len(x) + len(y)
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def extend(x: list[bytes], y: list[bytes], i: int, j: int, step: int, drop: int = 3) -> tuple[int, int]:
    """(words, edits) by which equal or substituted words go on; stops once the score falls by ``drop``."""
    score = top = best = wrong = wrong_at = n = 0
    while 0 <= i < len(x) and 0 <= j < len(y):
        n += 1
        if x[i] == y[j]:
            score += 1
        else:
            score -= 1
            wrong += 1
        if score > top:
            top, best, wrong_at = score, n, wrong
        if score <= top - drop:
            break
        i, j = i + step, j + step
    return best, wrong_at


def extended(x: list[bytes], y: list[bytes], piece: list[tuple[int, int]], cost: int, k: int,
             similarity: float) -> tuple[int, int, int, int, int] | None:
    """The piece with the longest ends that keep it similar enough; a single seed with equal ends always is."""
    (p0, q0), (p1, q1) = piece[0], piece[-1]
    for drop in (3, 2, 1):                      # 1: equal words only
        before, wrong = extend(x, y, p0 - 1, q0 - 1, -1, drop)
        after, wrong2 = extend(x, y, p1 + k, q1 + k, 1, drop)
        s, e, qs, qe = p0 - before, p1 + k + after, q0 - before, q1 + k + after
        total = cost + wrong + wrong2
        if total <= (1 - similarity) * max(e - s, qe - qs):
            return s, e, qs, qe, total
    return None


def align(x: list[bytes], y: list[bytes], ps: list[int], qs: list[int], k: int,
          similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end, partner start, partner end, edits) of the fragments of a chain that are similar enough."""
    # Seeds are verified on the words; a gap that is mostly edits breaks the chain.
    seeds = [(p, q) for p, q in zip(ps, qs) if x[p:p + k] == y[q:q + k]]
    pieces, current, costs = [], [], []         # ``costs`` has the edits before each seed, 0 before the first
    for p, q in seeds:
        c = 0
        if current:
            p0, q0 = current[-1]
            gx, gy = max(0, p - p0 - k), max(0, q - q0 - k)
            if p - p0 < k or q - q0 < k:        # overlapping seeds: the shift between them is the edit
                c = abs((p - p0) - (q - q0))
            else:
                c = edits(x[p0 + k:p], y[q0 + k:q])
            if c > 4 and c > (1 - similarity) * (max(gx, gy) + k):
                pieces.append((current, costs))
                current, costs, c = [], [], 0
        current.append((p, q))
        costs.append(c)
    if current:
        pieces.append((current, costs))
    out, pieces = [], pieces[::-1]
    while pieces:
        piece, costs = pieces.pop()
        found = extended(x, y, piece, sum(costs), k, similarity)
        if found:
            out.append(found)
        else:                                   # too many edits: the piece breaks at its worst gap
            over = [c - (1 - similarity) * max(p - p0, q - q0)
                    for c, (p, q), (p0, q0) in zip(costs[1:], piece[1:], piece)]
            cut = over.index(max(over)) + 1
            pieces += [(piece[cut:], [0] + costs[cut + 1:]), (piece[:cut], costs[:cut])]
    return out


def _whole_runs(batches, key_columns: int):
    """Arrow batches regrouped so that rows with equal leading columns come together."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(held[0]):
            continue
        last = np.ones(len(held[0]), dtype=bool)
        for c in held[:key_columns]:
            last &= c == c[-1]
        cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def document_seeds(docs: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """(seed, n, pos) of all texts that can hold a passage; ``docs`` has columns n and text."""
    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(0, batch.num_rows, 256):
                seeds, ns, places = [], [], []
                for n, t in zip(batch.column(0).slice(i, 256).to_pylist(), texts.slice(i, 256).to_pylist()):
                    w = words_of(t)
                    if len(w) >= min_words:
                        h, at = seeds_of(w, k, window)
                        seeds.append(h)
                        places.append(at)
                        ns.append(np.full(len(h), n, dtype=np.int64))
                if seeds:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (seeds, ns, places)],
                                                     names=["seed", "n", "pos"])

    return docs.select("n", "text").mapInArrow(emit, "seed long, n long, pos int")


def seed_matches(docs: DataFrame, k: int, window: int, min_words: int, group_rows: int = 20_000,
                 sample: int = 64) -> DataFrame:
    """(n, pos, an, apos): every seed occurrence that another document shares, with one partner occurrence.

    One in ``sample`` documents is counted to find the seeds that need several groups. That decides the
    layout only; all occurrences are matched either way.
    """
    few = document_seeds(docs.filter(F.pmod(F.col("n"), F.lit(sample)) == 0), k, window, min_words)
    hot = durable(few.groupBy("seed").agg(F.count("*").alias("c"))
                  .filter(F.col("c") >= max(2, group_rows // sample))
                  .select("seed", F.ceil(F.col("c") * sample / group_rows * 2).cast("int").alias("parts")), "hot")
    every = document_seeds(docs, k, window, min_words)
    salted = every.join(hot, "seed", "left").select(
        "seed", F.coalesce(F.pmod(F.xxhash64("n"), F.col("parts")), F.lit(0)).cast("int").alias("salt"), "n", "pos",
        F.col("parts").isNotNull().alias("hot"))

    def link(batches):
        import pyarrow as pa

        for seed, salt, n, pos, is_hot in _whole_runs(batches, 2):
            (a, b, c, d), start = link_runs(seed, salt, n, pos)
            first = start[is_hot[start].astype(bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((a, n[first]))), pa.array(np.concatenate((b, pos[first])).astype(np.int32)),
                 pa.array(np.concatenate((c, seed[first]))), pa.array(np.concatenate((d, pos[first] * 0)).astype(np.int32)),
                 pa.array(np.concatenate((np.zeros(len(a), bool), np.ones(len(first), bool))))],
                names=["n", "pos", "an", "apos", "first"])

    def stars(rows):
        return (rows.select("seed", "salt", "n", "pos", "hot").repartition("seed", "salt")
                .sortWithinPartitions("seed", "salt", "n", "pos")
                .mapInArrow(link, "n long, pos int, an long, apos int, first boolean"))

    out = durable(stars(salted), "matches")
    # the first occurrences of a hot seed's groups (with the seed in place of a partner) form one more star
    again = stars(out.filter("first").select(F.col("an").alias("seed"), F.lit(0).alias("salt"), "n", "pos",
                                             F.lit(False).alias("hot")))
    return out.filter("not first").drop("first").unionByName(again.drop("first"))


def document_pairs(docs: DataFrame, k: int, window: int, min_words: int, min_seeds: int) -> DataFrame:
    """(n, an, chains): each document with a partner and all their chains, written once."""
    def chain(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("ps", pa.list_(pa.int32())), ("qs", pa.list_(pa.int32()))]))
        for n, an, pos, apos in _whole_runs(batches, 1):
            start = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
            ids, partners, chains = [], [], []
            for s, e in zip(start, np.append(start[1:], len(n))):
                pairs: dict[int, list] = {}
                for a, p, q in document_chains(an[s:e], pos[s:e], apos[s:e], k, window, min_words, min_seeds):
                    pairs.setdefault(a, []).append({"ps": p, "qs": q})
                ids += [int(n[s])] * len(pairs)
                partners += pairs
                chains += pairs.values()
            for i in range(0, len(ids), 2_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:i + 2_000], pa.int64()), pa.array(partners[i:i + 2_000], pa.int64()),
                     pa.array(chains[i:i + 2_000], kind)], names=["n", "an", "chains"])

    matches = seed_matches(docs, k, window, min_words).select("n", "an", "pos", "apos")
    return durable(matches.repartition("n").sortWithinPartitions("n").mapInArrow(
        chain, "n long, an long, chains array<struct<ps:array<int>,qs:array<int>>>"), "chains")


def passage_fragments(docs: DataFrame, k: int = 5, window: int = 16, min_words: int = 50,
                      similarity: float = 0.8, min_seeds: int = 2) -> DataFrame:
    """(n, start, end, an, astart, aend, edits): aligned fragments in word offsets; ``docs`` has n and text."""
    docs = docs.select("n", "text")
    pairs = document_pairs(docs, k, window, min_words, min_seeds)
    margin = 2 * (window + k)                   # beyond it another seed would have been matched
    ends = lambda side: (F.array_min(F.transform("chains", lambda c: c[side][0])).alias("low"),
                         F.array_max(F.transform("chains", lambda c: F.element_at(c[side], -1))).alias("high"))
    none = F.lit(None).cast("array<struct<ps:array<int>,qs:array<int>>>").alias("chains")
    asked = pairs.select(F.col("n").alias("id"), "n", "an", F.lit(0).alias("side"), *ends("ps"), "chains").unionByName(
        pairs.select(F.col("an").alias("id"), "n", "an", F.lit(1).alias("side"), *ends("qs"), none))
    joined = docs.withColumnRenamed("n", "id").join(asked, "id").select(
        "n", "an", "side", "low", "high", "chains", F.col("text").cast("binary").alias("text"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                offsets, slices, at = [], [], None
                for low, high, text in zip(*(part.column(j).to_pylist() for j in (3, 4, 6))):
                    if at is None or text != at:
                        at, words = text, words_of(text)
                    offsets.append(max(0, low - margin))
                    slices.append(b" ".join(words[max(0, low - margin):high + k + margin]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in (0, 1, 2)), pa.array(offsets, pa.int32()), pa.array(slices, pa.binary()),
                     part.column(5)], names=["n", "an", "side", "offset", "words", "chains"])

    slices = joined.mapInArrow(cut, "n long, an long, side int, offset int, words binary, "
                                    "chains array<struct<ps:array<int>,qs:array<int>>>")

    def refine(batches):
        import pyarrow as pa

        waiting = None
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for n, an, side, offset, words, chains in zip(*(c.to_pylist() for c in part.columns)):
                    if side == 0:
                        waiting = offset, words.split(b" "), chains
                        continue
                    o, x, mine = waiting
                    y = words.split(b" ")
                    for c in mine:
                        for s, e, qs, qe, cost in align(x, y, [p - o for p in c["ps"]], [q - offset for q in c["qs"]],
                                                        k, similarity):
                            rows.append((n, s + o, e + o, an, qs + offset, qe + offset, cost))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(),
                                                                 pa.int32(), pa.int32(), pa.int32()))],
                    names=["n", "start", "end", "an", "astart", "aend", "edits"])

    # both sides of a pair come next to each other
    return slices.repartition("n", "an").sortWithinPartitions("n", "an", "side").mapInArrow(
        refine, "n long, start int, end int, an long, astart int, aend int, edits int")


def passages(fragments: DataFrame, min_words: int = 50) -> DataFrame:
    """Fragments in stretches of at least ``min_words``, with the stretch (``run_start``, ``run_end``)."""
    by = W.partitionBy("n").orderBy("start", "end")
    so_far = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= F.col("so_far"), 0).otherwise(1)).over(
        by.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = W.partitionBy("n", "run")
    return (fragments.withColumn("so_far", so_far).withColumn("run", run)
            .withColumn("run_start", F.min("start").over(whole)).withColumn("run_end", F.max("end").over(whole))
            .filter(F.col("run_end") - F.col("run_start") >= min_words).drop("so_far", "run"))


def with_numbers(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, text): ``n`` stands for a document, rows with equal id and text being one."""
    tk = text_key(F.col(text))
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), tk).alias("n"),
                       F.col(text).cast("string").alias("text"))


def shared_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, window: int = 16,
                    min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """(key, component, n_links, n_passages, n_words_shared, passages) for every row.

    ``n_links`` counts the partners in the stars, ``passages`` are the stretches ``start:end`` in words.
    """
    rows = with_numbers(docs, text, key)
    texts = durable(rows.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1").select("n"), "repeated")
    if texts.isEmpty():
        unique = rows.select("n", "text")
    else:                                       # repeated rows are one document
        some = rows.join(texts, "n", "left_semi").dropDuplicates(["n"]).select("n", "text")
        unique = rows.join(texts, "n", "left_anti").select("n", "text").unionByName(some)
    kept = durable(passages(passage_fragments(unique, k, window, min_words, similarity), min_words), "passages")
    ids = rows.select("key", "n")
    linked = kept.filter(F.col("end") - F.col("start") >= min(min_words, k + window)).select("n", "an").distinct()
    roots = connected(linked, "n", "an")
    named = ids.join(roots.withColumnRenamed("node", "n"), "n", "left").select("key", "n", "root")
    named = durable(named, "named")
    least = named.filter("root is not null").groupBy("root").agg(F.min("key").alias("component"))
    spans = kept.select("n", "run_start", "run_end").distinct().groupBy("n").agg(
        F.count("*").alias("n_passages"), F.sum(F.col("run_end") - F.col("run_start")).alias("n_words_shared"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_start", "run_end"))), lambda s: F.concat_ws(
            ":", s["run_start"], s["run_end"])), ",").alias("passages"))
    links = linked.groupBy("n").agg(F.count("*").alias("n_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (named.join(least, "root", "left").join(spans, "n", "left").join(links, "n", "left")
            .select("key", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"),
                    zero("n_links"), zero("n_passages"), zero("n_words_shared"),
                    F.coalesce("passages", F.lit("")).alias("passages")))
