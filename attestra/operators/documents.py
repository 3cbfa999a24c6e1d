"""Document analysis as table jobs (D1-D6): the inputs are values already taken out of the files."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions.text import phash_distance
from attestra.operators.graph import connected
from attestra.policy import EDITOR_SIGNATURES
from attestra.session import durable

# Metadata concerns.
NO_EXIF = "No EXIF metadata present (expected on a camera capture)"
EDITED = "Metadata names image editing software: %s"
DISAGREE = "Capture and modification timestamps disagree"
PDF_EDITED = "PDF %s names editing software: %s"
PDF_EMPTY = "PDF carries no document information dictionary"


def distinct_documents(docs: DataFrame, key: str = "doc_hash") -> DataFrame:
    """One row per content, the first in key order of the rest, so the choice is repeatable."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tile_pool(pixels: DataFrame, tile: int = 40, doc: str = "doc_hash",
              values: tuple[str, ...] = ("error", "texture")) -> DataFrame:
    """D3: means over full tiles of (doc, x, y, values); the ragged edge is left out.

    A document's extent is a pre-aggregated maximum joined back, so pixels are never gathered.
    """
    extent = pixels.groupBy(doc).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    tx, ty = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)
    inside = (tx < F.floor(F.col("_w") / tile)) & (ty < F.floor(F.col("_h") / tile))
    return (pixels.join(extent, doc).filter(inside)
            .groupBy(doc, tx.cast("int").alias("tile_x"), ty.cast("int").alias("tile_y"))
            .agg(*[F.avg(v).alias(v) for v in values]))


def anomaly_score(tiles: DataFrame, percentile: float = 0.95, doc: str = "doc_hash",
                  documents: DataFrame | None = None) -> DataFrame:
    """The high percentile of texture-normalised error, linear interpolation.

    With ``documents`` those without a full tile appear with 0.0.
    """
    ratio = 100.0 * F.col("error") / (F.col("texture") + 0.5)
    scored = tiles.groupBy(doc).agg(F.percentile(ratio, percentile).alias("ela_score"))
    if documents is None:
        return scored
    return documents.select(doc).distinct().join(scored, doc, "left").select(
        doc, F.coalesce("ela_score", F.lit(0.0)).alias("ela_score"))


def _edited(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(s) for s in EDITOR_SIGNATURES])


def metadata_flags(meta: Column) -> Column:
    """D4 for images: ``meta`` is a map of EXIF tags (Software, DateTimeOriginal, DateTime)."""
    software = F.coalesce(F.try_element_at(meta, F.lit("Software")), F.lit(""))
    shot, changed = (F.try_element_at(meta, F.lit(k)) for k in ("DateTimeOriginal", "DateTime"))
    empty = meta.isNull() | (F.size(meta) <= 0)
    return F.when(empty, F.array(F.lit(NO_EXIF))).otherwise(F.array_compact(F.array(
        F.when(_edited(software), F.format_string(EDITED, software)),
        F.when((shot != "") & (changed != "") & (shot != changed), F.lit(DISAGREE)))))


def pdf_metadata_flags(meta: Column) -> Column:
    """D4 for PDF: ``meta`` is the document information map (Producer, Creator)."""
    found = []
    for name in ("Producer", "Creator"):
        value = F.coalesce(F.try_element_at(meta, F.lit(name)), F.lit(""))
        found.append(F.when(_edited(value), F.format_string(PDF_EDITED, F.lit(name), value)))
    empty = meta.isNull() | (F.size(meta) <= 0)
    return F.when(empty, F.array(F.lit(PDF_EMPTY))).otherwise(F.array_compact(F.array(*found)))


def near_duplicate_documents(docs: DataFrame, max_distance: int = 4, phash: str = "phash") -> DataFrame:
    """Pairs of different perceptual hashes at most ``max_distance`` bits apart.

    Works on distinct hashes, so copies of one image never pair up. The 64 bits are cut in
    ``max_distance + 2`` bands: two hashes that close agree on at least two of them, so pairs of bands
    are the join keys and the distance is checked inside the join. Each pair comes out under its
    first common key only, which needs no de-duplication shuffle.
    """
    hashes = docs.filter(F.col(phash).rlike(r"^[0-9a-fA-F]{16}$")).select(F.lower(phash).alias("h")).distinct()
    hi, lo = (F.conv(F.substring("h", s, 8), 16, 10).cast("long") for s in (1, 9))
    n = max_distance + 2
    cuts = [round(i * 64 / n) for i in range(n + 1)]

    def bits(a: int, b: int) -> Column:
        # Bits a..b counted from the left; a band may straddle the two halves.
        out = F.lit(0).cast("long")
        for word, start in ((hi, 0), (lo, 32)):
            s, e = max(a, start), min(b, start + 32)
            if s < e:
                part = F.shiftright(word, start + 32 - e).bitwiseAND((1 << (e - s)) - 1)
                out = F.shiftleft(out, e - s).bitwiseOR(part)
        return out

    bands = [bits(a, b) for a, b in zip(cuts, cuts[1:])]
    pairs = list(combinations(range(n), 2))
    keyed = hashes.select("h", F.array(*bands).alias("bands")).select("h", "bands", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("bands")[i].alias("p"), F.col("bands")[j].alias("q"))
        for k, (i, j) in enumerate(pairs)])).alias("key")).select("h", "bands", "key.*")
    left = keyed.select("k", "p", "q", F.col("h").alias("phash_a"), F.col("bands").alias("ba"))
    right = keyed.select("k", "p", "q", F.col("h").alias("phash_b"), F.col("bands").alias("bb"))
    same = F.zip_with("ba", "bb", lambda x, y: x == y)
    first_common = F.lit(len(pairs))
    for k, (i, j) in reversed(list(enumerate(pairs))):
        first_common = F.when(same[i] & same[j], k).otherwise(first_common)
    distance = phash_distance(F.col("phash_a"), F.col("phash_b"))
    return (left.join(right, ["k", "p", "q"]).filter("phash_a < phash_b")
            .filter(first_common == F.col("k")).withColumn("distance", distance)
            .filter(F.col("distance") <= max_distance).select("phash_a", "phash_b", "distance"))


def _bit(i: Column) -> Column:
    """The long with bit ``i`` set, for a column or lambda variable ``i``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def near_duplicate_groups(docs: DataFrame, max_distance: int = 4, phash: str = "phash", full: int = 1000) -> DataFrame:
    """D5 as groups: every perceptual hash with the smallest hash it is linked to, over steps of at most ``max_distance`` bits, and
    its distance from that one. One row for each hash, however dense the groups are.

    Two hashes that close agree on one of ``max_distance + 1`` bands of bits. A bucket with more than ``full`` hashes is cut again by bands
    of the bits in which its hashes still differ; no pair is lost, as its differing bits are among these. A cut that does not
    halve the comparisons is not made: such a bucket holds hashes that are nearly all close to each other.
    """
    n = max_distance + 1
    hashes = docs.filter(F.col(phash).rlike(r"^[0-9a-fA-F]{16}$")).select(F.lower(phash).alias("h")).distinct()
    rows = durable(hashes.select("h", F.conv("h", 16, -10).cast("long").alias("bits"), F.lit("").alias("key")), "hashes")
    parents = rows.groupBy("key").agg(F.count("*").alias("size"), F.lit(-1).cast("long").alias("free"))
    buckets = None
    while True:
        # Each bucket's own bands: its differing bits in n runs, each as a mask.
        places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("free").bitwiseAND(_bit(i)) != 0)
        cut = [F.floor(F.size("places") * k / n).cast("int") for k in range(n + 1)]
        masks = F.array(*[F.aggregate(F.slice("places", cut[k] + 1, cut[k + 1] - cut[k]), F.lit(0).cast("long"),
                                      lambda m, i: m.bitwiseOR(_bit(i))) for k in range(n)])
        bands = durable(parents.withColumn("places", places).select("key", "size", masks.alias("masks")), "masks")
        keyed = rows.join(bands, "key").select("h", "bits", F.col("key").alias("parent"), "size", F.posexplode("masks").alias("k", "mask"))
        keyed = durable(keyed.select("h", "bits", "parent", "size", F.concat_ws(
            "|", "parent", "k", F.col("bits").bitwiseAND(F.col("mask"))).alias("key")), "bands")
        counts = keyed.groupBy("parent", "size", "key").agg(F.count("*").alias("n"), F.bit_or("bits").bitwiseXOR(F.bit_and("bits")).alias("free"))
        counts = durable(counts, "counts")
        useful = counts.groupBy("parent", "size").agg(F.sum(F.col("n") * F.col("n")).alias("work")) \
            .filter((F.col("size") * F.col("size") > 2 * F.col("work")) | (F.col("parent") == "")).select("parent")
        as_is = rows.join(useful.withColumnRenamed("parent", "key"), "key", "left_anti").select("h", "key")
        kept = counts.join(useful, "parent")
        more = durable(kept.filter((F.col("n") > full) & (F.bit_count("free") >= n)).select("key", F.col("n").alias("size"), "free"), "full")
        fine = keyed.join(kept.select("key"), "key", "left_semi").join(more.select("key"), "key", "left_anti").select("h", "key")
        part = as_is.unionByName(fine)
        buckets = part if buckets is None else buckets.unionByName(part)
        if more.isEmpty():
            break
        rows, parents = keyed.join(more.select("key"), "key", "left_semi").select("h", "bits", "key"), more
    pairs = buckets.withColumnRenamed("h", "a").join(buckets.withColumnRenamed("h", "b"), "key").filter(
        (F.col("a") < F.col("b")) & (phash_distance(F.col("a"), F.col("b")) <= max_distance)).select("a", "b")
    roots = connected(pairs, "a", "b")
    found = hashes.join(roots, hashes["h"] == roots["node"], "left").select("h", F.coalesce("root", "h").alias("representative"))
    return found.select(F.col("h").alias("phash"), "representative",
                        phash_distance(F.col("h"), F.col("representative")).alias("distance"))


def document_summary() -> Column:
    """D6 on columns doc_hash, ela_score, metadata_flags."""
    body = F.to_json(F.struct(
        F.substring("doc_hash", 1, 12).alias("hash"), F.bround("ela_score", 2).alias("ela"),
        F.coalesce(F.size("metadata_flags"), F.lit(0)).alias("metadata_flags")),
        {"ignoreNullFields": "false"})
    return F.when(F.col("doc_hash").isNull(), F.lit("no document")).otherwise(body)
