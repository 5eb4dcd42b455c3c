"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, named, stored

#: A document's place on [0, 2^60): five digits of 12 bits each.
BITS, LEVELS = 12, 5
MAX_BROADCAST_SOURCES = 100_000


def doc_hash() -> Column:
    """60 bits of md5 of id and text (null: empty), so that rows without an id, or of one id, part by their texts."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def ordered(df: DataFrame, order: list[Column], sums: Sequence[str], rows: int) -> DataFrame:
    """df with `_n`, each row's number in the order, and `_before_<c>`, the sum of c of the rows before it.

    Few rows (counted) are one window. More are dealt by ranges and written; windows within a range then start from the
    totals of the ranges before it, of which there are as many as partitions."""
    if rows <= MAX_BROADCAST_SOURCES:
        w = Window.orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({"_n": F.row_number().over(w), **{f"_before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in sums}})
    dealt = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0.0)).alias(f"_s{i}") for i in range(len(sums))])
    w = Window.partitionBy("_p").orderBy(*order)
    own = w.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({"_n": F.row_number().over(w), **{f"_before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0.0)) for c in sums}})
    out = out.join(F.broadcast(totals), F.col("_p") == F.col("_q"))
    out = out.withColumns({"_n": F.col("_n") + F.col("_c"), **{f"_before_{c}": F.col(f"_before_{c}") + F.col(f"_s{i}") for i, c in enumerate(sums)}})
    return out.drop("_p", "_q", "_c", *[f"_s{i}" for i in range(len(sums))])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, get the repeating weights and share `share` of all sizes; a target stops at
    `most` times its source's size and the excess is dealt again by weight. In the order of cap / weight the sources that
    stop are a prefix, so the water level is found in one pass over running sums of caps and weights.
    """
    sizes = stored(sizes, "mix-sources")
    rows = sizes.count()
    name = F.col("source").asc_nulls_last()
    df = ordered(sizes, [name], [], rows)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    df = stored(df.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")), "mix-weights")
    size, weight = df.agg(F.sum("source_size"), F.sum("w")).first()
    reach = F.col("cap") / F.col("w")
    level = (F.lit(share * (size or 0)) - F.col("_before_cap")) / (F.lit(weight or 0.0) - F.col("_before_w"))
    levels = ordered(df, [reach, name], ["cap", "w"], rows).withColumn("level", level)
    # Where the level first stays under the cap of its row, it is the level of all the sources that don't stop.
    found = levels.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min_by("level", reach)).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("w"))
    return df.select("source", "source_size", target.alias("target"))


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row, written to the shared folder: the histograms never read the texts again."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(documents.select("doc_id", "source", size.alias("size"), doc_hash().alias("h")), "mix")


def by_source(df: DataFrame, other: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """A join on source, null equal to null; the side of one row per source is broadcast if it was counted as small."""
    other = other.withColumnRenamed("source", "_s")
    return df.join(F.broadcast(other) if small else other.hint("merge"), df["source"].eqNullSafe(other["_s"]), how).drop("_s")


def thresholds(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, threshold), and whether there are few enough sources to broadcast it.

    Sizes are summed by source and hash bucket; in the bucket where a source's budget ends its rows are summed by the next
    BITS bits, and so on to the last bit, so nothing is sorted and each pass takes only the boundary bucket's rows. The
    rows of the last boundary hash are taken if that comes nearer to the budget.
    """
    state = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # whole: full takes of every row; prefix: the hash digits so far of the boundary; left: the budget when it is reached.
    state = state.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = stored(state, "mix-targets")
    small = state.count() <= MAX_BROADCAST_SOURCES
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        near = by_source(rows, state.select("source", "prefix"), small).where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = near.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        ends = by_source(run, state.select("source", "left"), small).where("upto > left").groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("end"))
        joined = by_source(state, ends, small, "left")
        over, below = F.col("end.upto") - F.col("left"), F.col("left") - (F.col("end.upto") - F.col("end.words"))
        at = F.col("end.bucket") + (F.when(over < below, 1).otherwise(0) if level == LEVELS - 1 else F.lit(0))
        # Without an end the budget outlasts the bucket (by rounding, or as nothing is there): the boundary lies behind it.
        at = F.coalesce(at, F.shiftleft(F.col("prefix") + 1, BITS))
        state = stored(joined.select("source", "source_size", "target", "whole", at.cast("long").alias("prefix"), F.coalesce(below, F.lit(0.0)).alias("left")), "mix-level")
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("threshold")), small


def copies(hash_column) -> Column:
    return (F.col("whole") + F.when(hash_column < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of documents.

    A document is taken floor(target / source_size) times, and once more if its hash lies under its source's threshold.
    Null text: size 0. Null sources are one source; rows alike in id, text and source share one hash, so they are decided
    alike. Empty input: empty result. Reruns agree, as nothing depends on partitions.
    """
    rows = sizes(documents)
    state, small = thresholds(rows, weights, share, most)
    out = by_source(rows, state, small).withColumn("copies", copies(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, count: str = "copies") -> DataFrame:
    """The rows of documents that the mix takes, with `count`, how often; one filter over documents, no shuffle of texts
    while the sources are few enough to broadcast. A column of documents of that name is replaced, so give another where
    documents have one called `copies`."""
    state, small = thresholds(sizes(documents), weights, share, most)
    packed = documents.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("doc"), "source", doc_hash().alias("h"))  # so that no name clashes
    out = by_source(packed, state.select("source", "whole", "threshold"), small).withColumn("copies", copies(F.col("h"))).where("copies > 0")
    return out.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(documents.columns) if c != count], F.col("copies").alias(count))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM t),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, cap / w) FILTER (level * w <= cap) AS level FROM l),
g AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN l.cap ELSE least(l.cap, f.level * l.w) END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM g),
c AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS words FROM s GROUP BY source, h),
e AS (SELECT c.source, min(c.h) AS h, min_by(c.upto, c.h) AS upto, min_by(c.words, c.h) AS words
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.upto > b.target - b.whole * b.source_size GROUP BY c.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
  CAST(b.whole + CASE WHEN e.h IS NULL OR s.h < e.h OR (s.h = e.h AND e.upto - (b.target - b.whole * b.source_size) < (b.target - b.whole * b.source_size) - (e.upto - e.words)) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((b.whole + CASE WHEN e.h IS NULL OR s.h < e.h OR (s.h = e.h AND e.upto - (b.target - b.whole * b.source_size) < (b.target - b.whole * b.source_size) - (e.upto - e.words)) THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON s.source IS NOT DISTINCT FROM e.source
"""
