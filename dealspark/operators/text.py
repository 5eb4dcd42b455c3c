"""Chunks and document assembly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of chunks that a task holds.
SENT = 1 << 20


def packed(text: str, size: int, sep: str) -> list[str]:
    """One text's chunks. Linear in the text, whatever the number of its paragraphs."""
    pieces = [(p[i : i + size], i + size < len(p)) for p in text.split(sep) for i in range(0, max(1, len(p)), size)]
    out, held, n = [], [], 0
    for piece, full in [*pieces, ("", True)]:
        if held and (full or n + len(piece) > size):
            out.append(sep.join(held).strip())
            held, n = [], 0
        if full and piece:
            out.append(piece.strip())
        elif piece or held:
            n += len(piece) + (len(sep) if held else 0)
            held.append(piece)
    return out[:-1] if out and not out[-1] else out


def pack(text: Column, size: int = 1800, sep: str = "\n\n") -> Column:
    """Paragraphs packed into chunks of about `size` characters; a longer paragraph is cut hard, its rest goes on as a
    paragraph. White space at a chunk's ends goes. An Arrow function, since a fold by expressions copies the chunks made so
    far at every paragraph."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(t or "", size, sep))

    return run(F.coalesce(text, F.lit("")))


def chunk(df: DataFrame, text: str = "text", size: int = 1800, sep: str = "\n\n") -> DataFrame:
    """The other columns and (seq, chunk, token_est), a row a chunk; rows leave a task by about SENT characters, so that long
    texts cost no more memory than one of them. Null and empty texts have no chunk."""
    rest = [f for f in df.schema if f.name != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seqs, chunks, held = [], [], [], 0
            for i, t in enumerate(batch.column(len(rest)).to_pylist()):
                for seq, one in enumerate(packed(t or "", size, sep)):
                    rows.append(i)
                    seqs.append(seq)
                    chunks.append(one)
                    held += len(one)
                if held > SENT:
                    yield made(batch, rows, seqs, chunks)
                    rows, seqs, chunks, held = [], [], [], 0
            yield made(batch, rows, seqs, chunks)

    def made(batch: pa.RecordBatch, rows: list[int], seqs: list[int], chunks: list[str]) -> pa.RecordBatch:
        kept = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*(kept.column(j) for j in range(len(rest))), pa.array(seqs, pa.int32()), pa.array(chunks, pa.string())], [*(f.name for f in rest), "seq", "chunk"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rest], T.StructField("seq", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return df.select(*[f.name for f in rest], text).mapInArrow(run, schema).withColumn("token_est", F.floor(F.length("chunk") / 4).cast("int"))


def assemble(chunks: DataFrame, key: str, title: str | None = None, cap: int = 120_000) -> DataFrame:
    """Chunks (seq, chunk) of a key in order as one text of at most `cap` characters; whole chunks beyond it are dropped
    before they are gathered, so a group stays bounded."""
    upto = F.sum(F.length("chunk")).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    near = chunks.withColumn("_before", F.coalesce(upto, F.lit(0))).where(F.col("_before") < cap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "\n\n")
    out = near.groupBy(key).agg(F.substring(text, 1, cap).alias("text"))
    return out if title is None else out.withColumn("text", F.concat(F.lit(title + "\n\n"), "text"))


def has_text_layer(pages: DataFrame, key: str, least: int = 25) -> DataFrame:
    return pages.groupBy(key).agg((F.sum(F.length(F.trim("text"))) / F.count("*") >= least).alias("has_text"))


def synthetic_chunk(name, summary, metrics, cap: int = 6000) -> Column:
    return F.substring(F.concat_ws("\n", name, summary, metrics), 1, cap)


def dedup_sources(hits: DataFrame) -> DataFrame:
    """The best hit (question, company, title, page, distance)."""
    n = F.row_number().over(Window.partitionBy("question", "company", "title", "page").orderBy("distance"))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")
