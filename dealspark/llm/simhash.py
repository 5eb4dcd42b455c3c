"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, map_texts, named, release, stored, typed

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Fingerprints of one bucket that meet in one task; a larger bucket is cut into blocks, and all pairs of blocks meet.
BLOCK = 4096
MAX_ROUNDS, MAX_HOT = 60, 10_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the shingles' hashes; no words: 0."""
    import xxhash

    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    ones, step = np.zeros(64, dtype=np.int64), 8192
    for start in range(0, n, step):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, min(n, start + step))], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every column of documents but text, and _fp (the 64 bits as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fp)], [*rest.schema.names, "_fp"])

    return map_texts(documents, run, typed(documents.drop("text"), "_fp long"))


def masks(radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks of the covering construction.

    Bit i gets the non-zero vector m(i) of radius + 1 bits, dealt in turn; mask v keeps the bits with <m(i), v> odd. The
    vectors of any `radius` bits span less than the whole space, so some v is orthogonal to all of them: its mask drops
    all of these bits, and two fingerprints that differ in no others agree under it.
    """
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, block: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints, each within the radius.

    A walk from each unvisited one takes in all unvisited ones within the radius, so no list of all pairs is made.
    """
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= radius
            if near.any():
                got = rest[near]
                rest = rest[~near]
                for y in got:
                    yield int(fp[x]), int(fp[y])
                queue.extend(got)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among the distinct fingerprints `_fp` that connect all that are within the radius of each other.

    Every fingerprint goes to one bucket of each table; keys held by one fingerprint only are dropped after a count with
    map-side sums. A bucket of more than BLOCK fingerprints is cut into blocks by hash, and each pair of blocks meets in
    a group of its own, so that a task's group stays bounded and no link is lost. Each group gives a spanning forest of
    its links, at most one row per fingerprint, not its pairs.
    """
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("_fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks(radius))])
    rows = distinct.select("_fp", F.explode(keys).alias("key"))
    # Written, as every aggregate that a hot key's rows meet here: only between plain exchanges is a hot partition split.
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    held = rows.join(shared.hint("merge"), "key")
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_fp", F.lit(7)), k).cast("int")
    held = held.select("key", "_fp", k.alias("k"), own.alias("own"))
    pairs = held.select("key", "_fp", F.explode(F.when(F.col("k") > 1, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0)))).alias("other"), "own")
    pairs = pairs.select("_fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_g, tail_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def solve(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            cuts = np.flatnonzero(np.diff(g)) + 1 if len(g) else []
            bounds = [0, *cuts, len(g)]
            sizes = np.diff(bounds)
            two = np.flatnonzero(sizes == 2)  # most groups
            i = np.asarray(bounds)[two]
            ok = np.bitwise_count(fp[i] ^ fp[i + 1]) <= radius if len(i) else np.empty(0, bool)
            pa_, pb_ = fp[i[ok]] if len(i) else fp[:0], fp[i[ok] + 1] if len(i) else fp[:0]
            for j in np.flatnonzero(sizes > 2):
                for x, y in _forest(np.unique(fp[bounds[j] : bounds[j + 1]]), None, radius):
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate([pa_, np.array(a, np.uint64)]).view(np.int64), np.concatenate([pb_, np.array(b, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            g = np.concatenate([tail_g, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([tail_f, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(g):
                continue
            last = np.searchsorted(g, g[-1])  # the last group may go on
            yield solve(g[:last], fp[:last])
            tail_g, tail_f = g[last:], fp[last:]
        yield solve(tail_g, tail_f)

    out = stored(pairs.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct(), "links")
    release(shared)
    return out


def star(ends: DataFrame, least: DataFrame) -> DataFrame:
    """Each end (u, v) with the least of u's neighbourhood, m."""
    return ends.join(least.hint("merge"), F.col("u") == F.col("w")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star steps, each written to the shared folder; they end when a step changes nothing.
    Groups are only aggregated (min), never gathered, so a node with many links is no burden to one task.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    for _ in range(MAX_ROUNDS):
        # Large star: each node links its greater neighbours to the least of its neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w"), "large-least")
        large = stored(star(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        release(edges, low)
        # Small star: each node links its lesser neighbours and itself to the least of them.
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "small-least")
        small = star(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "small-star")
        release(large, low)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    own = edges.groupBy("u").agg(F.min("v").alias("root"))
    out = stored(own.select(F.col("u").alias("node"), "root").unionByName(own.select(F.col("root").alias("node"), "root").distinct()), "roots")
    release(edges)
    return out


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_fp, _component): for each distinct fingerprint of prints (doc_id, _fp) the least doc_id of its component.

    Equal fingerprints are one node, so copies cost a row of an aggregate. A component whose ids are all null has null.
    """
    nodes = stored(prints.groupBy("_fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes.select("_fp"), radius)
    roots = components(found)
    rooted = stored(nodes.join(roots.hint("merge"), F.col("_fp") == F.col("node"), "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root")), "rooted")
    best = stored(rooted.groupBy("root").agg(F.min("least").alias("_component"), F.count("*").alias("n")).withColumnRenamed("root", "_root"), "best")
    release(nodes, found, roots)
    # At most MAX_HOT roots hold more than their share of all nodes: these are broadcast, so no task gets a large component.
    share = max(1000, rooted.count() // MAX_HOT)
    hot, rest = F.broadcast(best.where(F.col("n") > share)), best.where(F.col("n") <= share)
    on = F.col("root") == F.col("_root")
    few = rooted.join(F.broadcast(best.where(F.col("n") > share).select("_root")), on, "left_anti").join(rest.hint("merge"), on)
    out = stored(few.unionByName(rooted.join(hot, on)).select("_fp", "_root", "_component"), "classes")
    release(rooted, best)
    return out


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents.

    Null and empty texts have fingerprint zero, linked like any other. Null ids count as greater than any other; repeated
    rows get a row each. Extra columns are not read. The last join is by fingerprint: a hot one is split by the
    adaptive skew join, since only its other side has one row per key.
    """
    prints = stored(fingerprints(documents.select("doc_id", "text"), shingle), "prints")
    found = classes(prints, radius).withColumnRenamed("_fp", "_f")
    out = prints.join(found.hint("merge"), F.col("_fp") == F.col("_f"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """documents with one row of each component: that with the least doc_id (null last), then the least hash of its columns.

    Rows are known by doc_id and a hash of their whole content, so that the texts take part in no shuffle but one join
    by these narrow keys; of rows alike in every column one is kept. Columns may have any names.
    """
    names = [named(c) for c in documents.columns]
    print_of = fingerprints(documents.select("doc_id", F.xxhash64(*names).alias("_row"), "text"), shingle)
    prints = stored(print_of, "prints")
    held = classes(prints.select("doc_id", "_fp"), radius)
    found = held.withColumnRenamed("_fp", "_f")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    firsts = prints.join(found.hint("merge"), F.col("_fp") == F.col("_f")).groupBy("_root").agg(F.min(order).alias("o"))
    firsts = stored(firsts.select(F.col("o.doc_id").alias("_id"), F.col("o._row").alias("_r")), "firsts")
    release(prints, held)
    # One row per component is left; equal rows are thinned among the kept ones only. The rows are packed, so no name clashes.
    packed = documents.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"), "doc_id", F.xxhash64(*names).alias("_row"))
    kept = packed.join(firsts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_r")), "left_semi")
    first = Window.partitionBy("doc_id", "_row").orderBy(F.lit(1))
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(documents.columns)])
