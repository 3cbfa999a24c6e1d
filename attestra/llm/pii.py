r"""Personal data: base patterns, and identifiers found through the contexts that base matches stand in.

Bootstrapping: every base match is a seed instance; the words to its left are a lexical pattern. Tokens that
look like identifiers but match no base pattern are unknown instances with patterns of their own. On the
graph of patterns and instances, a pattern scores the share of its occurrences that are held by believed
instances, an instance believes its best patterns, and this is repeated a fixed number of rounds. Unknown
instances in patterns of high confidence and enough different seeds become spans of the pattern's kind.
DataFrame functions only.

Offsets are code points. They come from the lengths of what lies between and inside matches, summed in two
levels, so that a text with very many matches stays far from quadratic.

Cases: NULL and empty texts have no spans; repeated rows get equal answers; ids may be NULL; ties between
kinds go to the kind listed first; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import let, text_key
from attestra.session import durable

KINDS = ("email", "ip", "card", "phone")
# Leftmost matches of the contract's patterns. A start inside a run is tried only where the last match ended,
# and runs are possessive: the matches are the same, without the backtracking over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    # every run of digits and single separators; shorter ones than 13 digits would be dropped anyway
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
TOKEN = r"(?:(?<!\S)|\G)\S*[0-9@]\S*"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<start:int,end:int,m:string,gap:string>>"
BLOCK = 64


def located(text: Column, pattern: str, guard: str) -> Column:
    """Leftmost non-overlapping matches with their code-point offsets and the text since the last match."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def place(gaps, found):
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

        def with_sizes(a):
            blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(a, b * BLOCK + 1, BLOCK)))
            offsets = let(sums, lambda s: F.transform(s, lambda x, b: total(F.slice(s, 1, b))))

            def with_offsets(o):
                def span(m, i):
                    block = F.floor(i / BLOCK).cast("int")
                    start = (F.get(o, block) + total(F.slice(a, block * BLOCK + 1, i - block * BLOCK))
                             + F.length(F.get(gaps, i)))
                    return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"),
                                                         m.alias("m"), F.get(gaps, i).alias("gap")))
                return F.transform(found, span)
            return let(offsets, with_offsets)
        return F.when(F.size(found) > 0, let(sizes, with_sizes)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(guard), let(F.split(text, pattern, -1), lambda g: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: place(g, f)))).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of the products added: divisible by ten."""
    n = F.length(digits)

    def value(i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def context(gap: Column) -> Column:
    """The last two words before a match, in lower case, digits as 0, marks dropped; empty at the start."""
    tail = F.regexp_extract(F.substring(gap, -80, 80), r"(?:(\S+)\s+)?(\S+)\s*$", 0)
    plain = F.regexp_replace(F.regexp_replace(F.lower(tail), "[0-9]+", "0"), r"[^\p{L}0\s]+", "")
    return F.btrim(F.regexp_replace(plain, r"\s+", " "))


def base_matches(text: Column) -> Column:
    """Struct with one array of (start, end, m, pattern) for each kind."""
    return F.struct(*[_valid_only(located(text, PATTERNS[k], GUARDS[k]), k).alias(k) for k in KINDS])


def _valid_only(spans: Column, kind: str) -> Column:
    return F.transform(F.filter(spans, lambda s: valid(kind, s["m"])), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), context(s["gap"]).alias("pattern")))


def unknown_tokens(text: Column, base: Column, least_digits: int) -> Column:
    """Identifier-like tokens clear of all base matches: (start, end, m, pattern)."""
    taken = F.flatten(F.array(*[base[k] for k in KINDS]))

    def core(s):
        inner = F.regexp_extract(s["m"], r"[A-Za-z0-9+].*[A-Za-z0-9]", 0)
        start = s["start"] + F.instr(s["m"], inner) - 1
        return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"), inner.alias("m"),
                        context(s["gap"]).alias("pattern"))

    def looks(s):
        digits = F.length(F.regexp_replace(s["m"], "[^0-9]", ""))
        return (F.length(s["m"]) >= 6) & ((digits >= least_digits) | (F.instr(s["m"], "@") > 0)) & (s["pattern"] != "")
    tokens = F.filter(F.transform(located(text, TOKEN, "[0-9@]"), core), looks)
    return let(taken, lambda t: F.filter(tokens, lambda s: ~F.exists(
        t, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def found_matches(docs: DataFrame, text: str = "text", key: str = "doc_id", least_digits: int = 5) -> DataFrame:
    """(key, tk, base, unknown) for every row, written once."""
    t = F.col(text)
    base = docs.select(F.col(key).alias("key"), text_key(t).alias("tk"), let(F.coalesce(t, F.lit("")), lambda x: let(
        base_matches(x), lambda b: F.struct(b.alias("base"), unknown_tokens(x, b, least_digits).alias("unknown"))))
        .alias("f"))
    return durable(base.select("key", "tk", "f.base", "f.unknown"), "matches")


def graph_edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n): occurrences of instances in patterns; ``kind`` is NULL for unknown ones."""
    seeds = [found.select(F.explode(f"base.{k}").alias("s"), F.lit(k).alias("kind")) for k in KINDS]
    rows = seeds + [found.select(F.explode("unknown").alias("s"), F.lit(None).cast("string").alias("kind"))]
    every = reduce(DataFrame.unionByName, rows).select("s.pattern", F.lower("s.m").alias("instance"), "kind")
    return every.filter("pattern <> ''").groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))


def trusted(edges: DataFrame, rounds: int = 3, smoothing: float = 0.5) -> DataFrame:
    """(pattern, kind, confidence, seeds) after the given number of rounds over the graph."""
    edges = durable(edges, "edges")
    belief = F.when(F.col("kind").isNotNull(), 1.0)
    scores = None
    for _ in range(rounds):
        if scores is None:
            held = edges.withColumn("score", F.coalesce(belief, F.lit(0.0)))
        else:                       # an unknown instance believes its best patterns together
            doubts = (edges.filter("kind IS NULL").join(scores.select("pattern", "confidence"), "pattern")
                      .groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))))
                                               .alias("believed")))
            held = edges.join(doubts, "instance", "left").withColumn(
                "score", F.coalesce(belief, F.col("believed"), F.lit(0.0)))
        sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in KINDS]
        kind = F.element_at(F.reverse(F.array_sort(F.array(*[
            F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k"))
            for i, k in enumerate(KINDS)]))), 1)["k"]
        scores = durable(held.groupBy("pattern").agg(
            (F.sum(F.col("score") * F.col("n")) / (F.sum("n") + smoothing)).alias("confidence"),
            F.count(F.col("kind")).alias("seeds"), *sums)
            .filter("seeds > 0").select("pattern", "confidence", "seeds", kind.alias("kind")), "patterns")
    return scores


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", min_confidence: float = 0.8,
                  min_seeds: int = 5, rounds: int = 3, least_digits: int = 5) -> DataFrame:
    """(key, base, spans) for every row: struct of base arrays, and all (kind, start, end) in order."""
    found = found_matches(docs, text, key, least_digits)
    patterns = trusted(graph_edges(found), rounds)
    good = patterns.filter((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds))
    more = (found.select("key", "tk", F.explode("unknown").alias("s"))
            .select("key", "tk", "s.pattern", "s.start", "s.end")
            .join(good.select("pattern", "kind"), "pattern")
            .groupBy(F.col("key").alias("k"), F.col("tk").alias("t"))
            .agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra")))
    joined = found.join(more, F.col("key").eqNullSafe(F.col("k")) & (F.col("tk") == F.col("t")), "left")
    extra = F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return joined.select("key", "base", F.flatten(F.array(*[_of_kind(k, extra) for k in KINDS])).alias("spans"))


def _of_kind(kind: str, extra: Column) -> Column:
    """Base and discovered spans of one kind, by start."""
    base = F.transform(f"base.{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    new = F.transform(F.filter(extra, lambda s: s["kind"] == kind),
                      lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.transform(F.array_sort(F.concat(base, new)), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
