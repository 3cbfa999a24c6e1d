"""Quality rules: text statistics, and lines that too many documents of a host share.

Lines are normalised and hashed; each host's line is counted by the number of different texts that hold
it, so copies of one text count once. Lines above the limit are boilerplate. A document that fails the
base rules, or keeps too few of its words without boilerplate, is rejected. DataFrame functions only.

Cases: NULL and empty texts have no words and fail the base rules; NULL hosts form one host; repeated
rows get equal answers, one each; a text of any length is read whole; ids may be NULL; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import let, text_key
from attestra.session import durable

GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
NO_HOST = "\x00"


def words(text: Column) -> Column:
    """White-space separated words; an empty array for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice. ``w`` must be a bound variable."""
    def covered(h):
        def flagged(s):
            same = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(at)))
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, flagged)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                          lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, let(windows, covered)).otherwise(0)


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    known = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(known, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(known) - F.length(F.regexp_replace(known, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), GAP, " "))


def text_lines(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, tk, h, words): the words each different line hash takes in each different text of a host."""
    each = F.transform(F.split(F.col(text), "\n"), lambda s: let(normalised(s), lambda n: F.struct(
        F.xxhash64(n).alias("h"),
        F.when(n == "", 0).otherwise(F.length(n) - F.length(F.translate(n, " ", "")) + 1).alias("words"))))
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.coalesce(F.col(host).cast("string"), F.lit(NO_HOST)).alias("host"), text_key(F.col(text)).alias("tk"),
        F.posexplode(F.filter(each, lambda s: s["words"] > 0)).alias("at", "line"))
    # A line at one place of one text is one fact, however many copies of the text there are.
    once = rows.groupBy("host", "tk", "at").agg(F.first("line").alias("line"))
    return once.groupBy("host", "tk", F.col("line.h").alias("h")).agg(F.sum("line.words").alias("words"))


def boilerplate_words(lines: DataFrame, min_documents: int = 20, max_share: float = 0.01) -> DataFrame:
    """(host, tk, lost): words of each text in lines that exceed the limit of its host.

    The limit is ``min_documents`` texts or ``max_share`` of the host's texts, whichever is more.
    """
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    hosts = (lines.select("host", "tk").distinct().groupBy("host").agg(F.count("*").alias("texts")))
    over = counts.join(hosts, "host").filter(F.col("n") > F.col("texts") * max_share).select("host", "h")
    return lines.join(over, ["host", "h"]).groupBy("host", "tk").agg(F.sum("words").alias("lost"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] = ("doc_id",),
            min_words: int = 50, repeat_percent: int = 50, min_documents: int = 20, max_share: float = 0.01,
            min_kept_share: float = 0.5) -> DataFrame:
    """Carried columns, statistics, ``lost_words`` in boilerplate, ``base_failed`` and ``kept``."""
    lines = durable(text_lines(docs, text, host), "lines")
    lost = boilerplate_words(lines, min_documents, max_share)
    stats = docs.select(F.struct(*carry).alias("doc"), text_statistics(F.col(text)).alias("s"),
                        F.coalesce(F.col(host).cast("string"), F.lit(NO_HOST)).alias("host"),
                        text_key(F.col(text)).alias("tk")).select("doc", "host", "tk", "s.*")
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    left = F.col("n_words") - lost_words
    depleted = (lost_words > 0) & ((left < min_words) | (left < F.col("n_words") * min_kept_share))
    return (stats.join(lost, ["host", "tk"], "left")
            .select(*[F.col(f"doc.{c}") for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", lost_words.alias("lost_words"), base_failed(min_words, repeat_percent)
                    .alias("base_failed"), (~(base_failed(min_words, repeat_percent) | depleted)).alias("kept")))
