"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda variable is bound where a column would be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    """``kind:start:end`` joined by commas, in the order given."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def text_key(text: Column) -> Column:
    """64-bit key of a text, defined for NULL as well; used beside the document id, never alone."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00")))


def per_text(df: DataFrame, text: str, carry: list[str], answer, fields: str, raw: bool = False) -> DataFrame:
    """``answer(list of texts) -> list of tuples`` beside the carried columns, in slices of bounded size.

    The carried columns come back inside a struct ``doc``, so they never clash with result names. Texts
    arrive as ``str`` or, with ``raw``, as UTF-8 ``bytes``; NULL is ``None``. A slice is at most 512 rows
    and closes at 2 million bytes, so memory follows the longest text and not the batch.
    """
    spark = df.sparkSession
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    schema = spark.createDataFrame([], fields).schema
    names = schema.fieldNames()
    out = held.select("doc").schema
    for f in schema.fields:
        out.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [to_arrow_schema(schema).field(n).type for n in names]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            ends = np.cumsum(sizes)
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, min(start + 512, int(np.searchsorted(ends, before + 2_000_000, "right"))))
                part = texts.slice(start, stop - start)
                rows = answer((part.cast(pa.binary()) if raw else part).to_pylist())
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(start, stop - start), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["doc", *names])
                start = stop

    return held.mapInArrow(run, out)
