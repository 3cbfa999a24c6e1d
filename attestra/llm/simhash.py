"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code puts
every 23-bit word within three bits of exactly one codeword; the codeword indices next to a segment (the
segment decoded as it is and with each single bit flipped) are its few fuzzy keys, and two segments that
differ in at most two bits always share one, because a word half-way between them is decoded on both sides.

Pigeonhole: with at most four differing bits in three segments, either some segment is equal and another
differs in at most two bits (keys: the equal segment with the other's fuzzy keys), or two segments differ in
one bit each and the third in at most two (keys: all three fuzzy; one side may use the plain decodings of
two segments). Fingerprints that meet under a key are verified by counting bits. Only different
fingerprints take part, and a bucket returns a spanning forest of its true links rather than its pairs.

Cases: NULL, empty and wordless texts have fingerprint zero and are linked like any other; fewer words than
a shingle form one shingle; repeated rows get equal answers; the component of rows without any id is NULL;
a text of any length is read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import per_text, text_key
from attestra.operators.graph import connected
from attestra.session import durable

GENERATOR = 0b110001110101           # fixed value: generator polynomial of the [23, 12, 7] code
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Bit is 1 where over half of the shingles' XXH64 hashes (seed 42) have it."""
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    count = max(1, len(w) - shingle + 1)
    h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, count, 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and the error pattern of each remainder."""
    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    flips = [1 << b for b in range(23)]
    for i, a in enumerate(flips):
        errors[_remainder(a)] = a
        for j, b in enumerate(flips[:i]):
            errors[_remainder(a | b)] = a | b
            for c in flips[:j]:
                errors[_remainder(a | b | c)] = a | b | c
    return low, high, errors


def decode(v: np.ndarray, tables) -> np.ndarray:
    """Index of the one codeword within three bits of each 23-bit word."""
    low, high, errors = tables
    return (v ^ errors[low[v & 4095] ^ high[v >> 12]]) >> 11


def fuzzy_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, plain): the keys of each fingerprint; ``plain`` marks keys that decode two segments as is."""
    segs = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near, first = [], []
    for seg, (_, width) in zip(segs, SEGMENTS):
        flips = np.array([0, *(1 << b for b in range(width))], dtype=np.int64)
        k = decode(seg[:, None] ^ flips[None, :], tables)
        plain = k[:, 0].copy()
        k.sort(axis=1)
        fresh = np.ones(k.shape, dtype=bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :-1]
        near.append([k[i][fresh[i]] for i in range(len(k))])
        first.append(plain)
    rows, keys, plains = [], [], []
    for r in range(len(fps)):
        n = [near[0][r], near[1][r], near[2][r]]
        mine = [((t << 36) | (segs[i][r] << 12)) | n[j] for t, (i, j) in enumerate(PAIRS)]
        asis = [np.ones(len(m), dtype=bool) for m in mine]
        cube = (6 << 36) | (n[0][:, None, None] << 24) | (n[1][None, :, None] << 12) | n[2][None, None, :]
        e = [x == first[s][r] for s, x in enumerate(n)]
        two = (e[0][:, None, None].astype(int) + e[1][None, :, None] + e[2][None, None, :]) >= 2
        mine.append(cube.ravel())
        asis.append(two.ravel())
        keys += mine
        plains += asis
        rows.append(sum(map(len, mine)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.repeat(np.arange(len(fps)), rows), np.concatenate(keys), np.concatenate(plains)


def forest(fps: np.ndarray, most: int = 4) -> list[tuple[int, int]]:
    """Spanning forest of the links among different fingerprints; each search step drops whom it reached."""
    rest = fps
    edges: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = np.bitwise_count(rest ^ x) <= most
            if close.any():
                reached = rest[close]
                edges += [(int(x), int(y)) for y in reached]
                queue.extend(reached)
                rest = rest[~close]
    return edges


def bucket_links(keys: np.ndarray, fps: np.ndarray, plain: np.ndarray, most: int = 4) -> np.ndarray:
    """Links found in whole buckets; rows are sorted by key."""
    if not len(keys):
        return np.empty((0, 2), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    useful = (sizes > 1) & np.logical_or.reduceat(plain, starts)
    two = starts[useful & (sizes == 2)]
    a, b = fps[two], fps[two + 1]
    ok = (np.bitwise_count(a ^ b) <= most) & (a != b)
    found = [np.stack([a[ok], b[ok]], axis=1)]
    for s, n in zip(starts[useful & (sizes > 2)], sizes[useful & (sizes > 2)]):
        edges = forest(np.unique(fps[s:s + n]), most)
        if edges:
            found.append(np.array(edges, dtype=np.uint64))
    links = np.concatenate(found)
    return np.unique(np.sort(links, axis=1), axis=0)


def fingerprint_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links that connect exactly what differs in at most four bits; ``fp`` must be distinct."""
    if most > 4:
        raise ValueError("the key scheme covers four differing bits")
    tables = golay_tables()

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 2_000):
                part = all_fps[i:i + 2_000]
                row, key, plain = fuzzy_keys(part, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(part[row].view(np.int64)), pa.array(plain)], names=["key", "fp", "plain"])

    def meet(batches):
        import pyarrow as pa

        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

        def links(part):
            e = bucket_links(*part, most).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False),
                   batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                   batch.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))        # the last bucket may go on in the next batch
            if cut:
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(held)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long, plain boolean")
    return (keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long"))


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 4) -> DataFrame:
    """Every row (carried columns as struct ``doc``) with its fingerprint ``fp`` as a signed long."""
    def answer(texts):
        return [(int(np.uint64(fingerprint(t, shingle)).view(np.int64)),) for t in texts]

    return per_text(docs, text, carry or ["doc_id"], answer, "fp long", raw=True)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 4,
                    shingle: int = 4) -> DataFrame:
    """(key, tk, fp, root, component) for every row.

    ``component`` is the smallest key reachable over links, ``root`` the smallest fingerprint, and ``tk``
    names the row's text.
    """
    src = docs.select(F.col(key).alias("key"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    rows = durable(fingerprints(src, "text", ["key", "tk"], shingle).select("doc.key", "doc.tk", "fp"), "fingerprints")
    least = durable(rows.groupBy("fp").agg(F.min("key").alias("key")), "distinct")
    roots = connected(fingerprint_links(least, most), "a", "b")
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "key", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("key").alias("component"))
    return rows.join(named.select("fp", "root").join(whole, "root"), "fp")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest key."""
    found = durable(near_duplicates(docs, text, key, most).select("key", "tk", "root"), "groups")
    rows = found.groupBy("root", "key", "tk").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("key").isNull().alias("unnamed"), "key", "tk", "copies")
    first = rows.groupBy("root").agg(F.min(order).alias("w")).select("w.key", "w.tk", "w.copies")
    whole = docs.select(F.struct("*").alias("doc"), F.col(key).alias("k"), text_key(F.col(text)).alias("t"))
    kept = whole.join(first, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("tk")))
    repeated = kept.filter("copies > 1").dropDuplicates(["k", "t"])
    return kept.filter("copies = 1").select("doc.*").unionByName(repeated.select("doc.*"))
