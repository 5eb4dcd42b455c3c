"""Exact nearest vectors: blocks of queries meet blocks of rows on a grid of tasks; nothing comes to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checkpoints import cut

#: Vectors of a block, and query blocks whose best rows a task holds before it sends them on.
BLOCK, HELD = 1024, 128


def packed(df: DataFrame, ident: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(at, dim, ids, data): df's rows in blocks of at most `block` vectors of one length, as the bytes of doubles, written.
    Rows whose vector is null, or holds a null, are in blocks of length 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at, values = np.asarray(column.offsets, dtype=np.int64), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            lost = np.concatenate([[0], np.cumsum(np.isnan(values))])
            dims = np.where(np.asarray(column.is_valid()) & (lost[at[1:]] == lost[at[:-1]]), np.diff(at), 0)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                rows = values[at[:-1][own][:, None] + np.arange(d)]
                for i in range(0, len(own), block):
                    held.setdefault(d, []).append((ids[own[i : i + block]], rows[i : i + block]))
                    if sum(len(x) for x, _ in held[d]) >= block:
                        yield from made(d, held.pop(d))
        for d, parts in held.items():
            yield from made(d, parts)

    def made(d: int, parts: list) -> Iterator[pa.RecordBatch]:
        ids, rows = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        for i in range(0, len(ids), block):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[i : i + block].tolist()], pa.list_(pa.int64())), pa.array([rows[i : i + block].tobytes()], pa.binary())], ["dim", "ids", "data"])

    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long"), F.col(vector).cast("array<double>"))
    return cut(rows.mapInArrow(run, "dim int, ids array<long>, data binary").withColumn("at", F.monotonically_increasing_id()))


def grid(rows: int, queries: int, tasks: int) -> tuple[int, int]:
    """(a, b): parts of the row blocks and of the query blocks, about `tasks` pairs of parts in all. Row blocks are copied b
    times and query blocks a times, so the fewer blocks a side has, the more often it is copied."""
    a = max(1, min(rows, round((tasks * rows / max(queries, 1)) ** 0.5)))
    return a, max(1, min(queries, round(tasks / a)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest rows of vectors (vec_id, embedding) to each row of queries (query_id,
    q), by exact cosine distance to three places, ties by vec_id.

    Each block of queries meets each block of rows once, in a task of a grid; a task keeps k rows of a query, and a window
    ranks those of all tasks. Rows without a distance (no vector, or one of another length or of no size) come last, with
    null; queries without a vector, and ids that are null, are left out. Repeated rows count each time."""
    rows, asked = packed(vectors, "vec_id", "embedding", block), packed(queries.where("q IS NOT NULL"), "query_id", "q", block)
    a, b = grid(rows.count(), asked.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    part = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(part(a).alias("a"), every(b).alias("b"), F.col("dim").alias("v_dim"), F.col("ids").alias("v_ids"), F.col("data").alias("v_data"))
    right = asked.select(every(a).alias("a"), part(b).alias("b"), F.col("at").alias("q_at"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = left.join(right.hint("merge"), ["a", "b"]).select("q_at", "q_dim", "q_ids", "q_data", "v_dim", "v_ids", "v_data")
    near = met.mapInArrow(_nearest(k), "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance", "rank")


def _nearest(k: int):
    def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - (q @ v.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :])
        return np.where(np.isfinite(d), np.floor(d * 1000 + 0.5) / 1000 + 0.0, np.inf)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                one = {n: batch.column(j)[i] for j, n in enumerate(names)}
                at, (qd, vd) = one["q_at"].as_py(), (one[f"{s}_dim"].as_py() for s in "qv")
                q_ids, v_ids = (one[f"{s}_ids"].values.to_numpy() for s in "qv")
                if qd == vd and qd:
                    q, v = (np.frombuffer(one[f"{s}_data"].as_buffer(), dtype=np.float64).reshape(-1, qd) for s in "qv")
                    d = distances(q, v)
                else:
                    d = np.full((len(q_ids), len(v_ids)), np.inf)
                held_d, held_v = best[at][1:] if at in best else (d[:, :0], np.zeros((len(q_ids), 0), np.int64))
                d, v_ids = np.concatenate([held_d, d], 1), np.concatenate([held_v, np.broadcast_to(v_ids, d.shape)], 1)
                order = np.lexsort((v_ids, d), axis=1)[:, :k]
                best[at] = (q_ids, np.take_along_axis(d, order, 1), np.take_along_axis(v_ids, order, 1))
                if len(best) > HELD:
                    yield from sent(best)
                    best = {}
        yield from sent(best)

    def sent(best: dict) -> Iterator[pa.RecordBatch]:
        for ids, d, v in best.values():
            flat = d.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, d.shape[1])), pa.array(v.ravel()), pa.array(flat, mask=np.isinf(flat))], ["query_id", "vec_id", "distance"])

    return run


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    each = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def comparables(means: DataFrame, key: str, k: int) -> DataFrame:
    """(a, b, distance, rank): the k nearest others of each entity of mean vectors, by the exact block search of `knn`;
    ties by key. Entities are numbered in the order of their keys and written first."""
    rows = cut(means.select(F.col(key).alias("name"), "embedding").orderBy("name").withColumn("vec_id", F.monotonically_increasing_id()))
    near = knn(rows.select("vec_id", "embedding"), rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k + 1)
    names = lambda at, name: rows.select(F.col("vec_id").alias(at), F.col("name").alias(name)).hint("merge")
    others = near.where("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    return others.join(names("query_id", "a"), "query_id").join(names("vec_id", "b"), "vec_id").select("a", "b", "distance", "rank")


def cited(company: str, title: str, source: str, page: str) -> Column:
    """How a hit is named: a deck by its company and page, all else by the first fifty characters of its title."""
    label = F.coalesce(F.nullif(F.col(company), F.lit("")), F.nullif(F.col(title), F.lit("")), F.lit("source"))
    deck = F.concat(label, F.lit(" — Deck"), F.when(F.coalesce(F.col(page), F.lit(0)) > 0, F.concat(F.lit(" p."), F.col(page).cast("string"))).otherwise(""))
    text = F.concat(label, F.lit(" — "), F.substring(F.translate(F.coalesce(F.col(title), F.lit("")), "\n", " "), 1, 50))
    return F.when(F.col(source) == "pdf", deck).otherwise(text)


def retrieved(hits: DataFrame, chunks: DataFrame, envelopes: DataFrame) -> DataFrame:
    """hits (query_id, vec_id, distance, rank) with where each comes from: company, title, source, kind, page, text, ref, cite.

    chunks: (vec_id, envelope_id, page, text, attachment_ref); envelopes: (envelope_id, company, title, source, status, ref).
    Only chunks of indexed envelopes are given, so rank them before: `knn` over the vectors of these. Hits are few, so they
    are written and the big tables meet them by a merge join on their keys."""
    few = cut(hits)
    own = few.join(chunks.hint("merge"), "vec_id").join(envelopes.where("status = 'indexed'").hint("merge"), "envelope_id")
    kind = S.source_kind(F.lit(None).cast("string"), "source", F.col("attachment_ref").isNotNull())
    return own.select(
        "query_id", "vec_id", "distance", "rank", "company", "title", "source", kind.alias("kind"), "page", "text", F.coalesce("attachment_ref", "ref").alias("ref"), cited("company", "title", "source", "page").alias("cite"),
    )
