"""Registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.llm import decontaminate, html_extract, language, lexical, mixture, passages, pii, preference, pseudo_likelihood, quality, secrets, simhash, whitening
from attestra.llm.common import table
from attestra.llm.sql import SQL

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op1_quality(spark, sf_dir):
    """Statistics, boilerplate and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op2_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op3_language(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~language.held_out()))
    return language.identify(docs, model).select(
        "doc.doc_id", F.expr("coalesce(crc32(cast(cast(doc.doc_id as string) as binary)) % 3 = 1, false)")
        .alias("held_out"), "lang_pred", "score")


@query
def op4_pii(spark, sf_dir):
    """Personal data of every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[F.transform(f"base.{k}", _named(k)) for k in pii.KINDS])
    return found.select(F.col("key").alias("doc_id"),
                        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
                                     ",").alias("spans"))


@query
def op5_decontaminate(spark, sf_dir):
    """Hit words and benchmark items of every document."""
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       decontaminate.digest().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


@query
def op6_mixture(spark, sf_dir):
    """Placed documents of a mixture with 97 % of the largest source entropy and four passes at most."""
    return mixture.mix(table(spark, sf_dir, "documents"))


@query
def op7_secrets(spark, sf_dir):
    """Secrets of every document: pattern spans and expensive credential values."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = [_count("base", k) for k in ("assign", "access", "hex")]
    return found.select("doc.doc_id", *count, F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"))


@query
def op8_passages(spark, sf_dir):
    """Passages that documents share, and the components they form."""
    return passages.shared_passages(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.col("component").alias("component_id"), "n_links", "n_passages",
        "n_words_shared", "passages")


@query
def op9_pseudo_likelihood(spark, sf_dir):
    """Masked pseudo-likelihood of every document under a network trained on the corpus."""
    docs = table(spark, sf_dir, "documents")
    found = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))
    return found.select("doc.doc_id", "n_tokens", "log_likelihood", "per_token")


@query
def op10_main_text(spark, sf_dir):
    """Main text of every page."""
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_whitening(spark, sf_dir):
    """Whitened principal components of every usable embedding."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("doc.vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
                        "whitened", "explained", "identity_error")


@query
def op12_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@query
def op13_preference(spark, sf_dir):
    """Quality score of every document, learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = preference.learn(docs, labels.filter(~preference.held_out(F.col("doc_id"))))
    return preference.rank(docs, model).select(
        "doc.doc_id", preference.held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")
