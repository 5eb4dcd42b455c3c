"""Source divergence audit: a K-squared tree over the matrix of group and term counts, pairs of groups walked down it together."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, release, stored

#: A term is kept in a language where at least so many of its documents hold it.
LEAST_DOCS = 30
#: p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), in whole numbers.
UNIT, PRIOR = 1_000_000_000, 5
#: Ranks of part `term`.
TOP = 50
#: A node of the tree has K x K children; a leaf is LEAF_ROWS groups by LEAF_TERMS terms.
K, LEAF_ROWS, LEAF_TERMS = 4, 32, 512
#: Tables of at most so many rows (counted) are broadcast.
MAX_BROADCAST = 100_000
#: Distinct terms, or bytes of the texts that brought them, that a task counts before it sends them on.
MOST_TERMS, MOST_BYTES = 500_000, 64 << 20
#: A-Z to a-z; every byte below 0x80 that is no letter to a blank.
TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it. A row without term stands for
    the group itself. Tasks count before anything is shuffled, so a frequent term or a hot source is a few rows a task."""

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                terms, before = text.translate(TO_TERMS).split(), len(n)
                n.update(terms)
                docs.update(set(terms))
                if len(n) > before:
                    held, size = held + len(n) - before, size + len(text)
                if held > MOST_TERMS or size > MOST_BYTES:
                    yield from _counted(groups)
                    groups, held, size = {}, 0, 0
        yield from _counted(groups)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    parts = map_texts(texts, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(groups: dict):
    for (lang, source), (n, docs) in groups.items():
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * (len(n) + 1), pa.string()), "source": pa.array([source] * (len(n) + 1), pa.string()), "term": pa.array([None, *(t.decode() for t in n)], pa.string()),
            "n": pa.array([0, *n.values()], pa.int64()), "docs": pa.array([0, *(docs[t] for t in n)], pa.int64()),
        })


def share(n: str, total: str, terms: str) -> Column:
    """p of a count by the names of the count, the group's total and the number of terms; in decimals, so that no product
    overflows."""
    return F.expr(f"1 + ((cast({n} AS decimal(20, 0)) + {PRIOR}) * {UNIT} div (cast({total} AS decimal(20, 0)) + cast({terms} AS decimal(18, 0)) * {PRIOR}))")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, written, with its rows' numbers within their language, from 0: ranges are sorted apart and continue each other."""
    dealt = stored(df.repartitionByRange("lang", *order).withColumn("_p", F.spark_partition_id()), f"{name}-ranges")
    totals = dealt.groupBy("lang", "_p").agg(F.count("*").alias("_c"))  # as many as ranges and languages
    before = Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.select("lang", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c")), f"{name}-starts")
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order)))
    out = stored(_meet(own, totals, ["lang", "_p"]).withColumn(name, F.col("_n") + F.col("_c") - 1).drop("_p", "_n", "_c"), name)
    release(dealt, totals)
    return out


def _meet(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a written table: broadcast if it counts few rows, else both are dealt by the key."""
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST else table.hint("merge"), on, how)


def matrix(documents: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(langs, groups, cells), all written: (lang, rows, terms, total); (lang, source, row, n, p0), p0 the share of a term
    that the group lacks; (lang, source, term, row, col, p, q) of each kept term that a group has, q the language's share.

    Columns are dealt so that terms that the same few sources have stand together: those of many sources come first,
    then by their first source."""
    counts = stored(count_terms(documents), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("sources"), F.min("source").alias("first"))
    kept = numbered(kept.where(F.col("docs") >= least_docs).drop("docs"), [F.desc("sources"), F.asc("first"), F.asc("term")], "col")
    cells = stored(counts.where("term IS NOT NULL").drop("docs").join(kept.select("lang", "term", "col", "all_n").hint("merge"), ["lang", "term"]), "divergence-kept")
    totals = counts.where("term IS NULL").select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(cells.select("lang", "source", "n"))
    groups = numbered(totals.groupBy("lang", "source").agg(F.sum("n").alias("n")), [F.asc("source")], "row")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = stored(sizes.join(terms.hint("merge"), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "divergence-langs")
    plain = groups
    p0 = F.when(F.col("terms") > 0, share("0", "n", "terms")).otherwise(0)
    groups = stored(_meet(plain, langs.select("lang", "terms"), ["lang"]).select("lang", "source", "row", "n", p0.alias("p0")), "divergence-groups")
    wide = _meet(_meet(cells, groups.select("lang", "source", "row", F.col("n").alias("group_n")), ["lang", "source"]), langs.select("lang", "terms", "total"), ["lang"])
    out = stored(wide.select("lang", "source", "term", "row", "col", share("n", "group_n", "terms").alias("p"), share("all_n", "total", "terms").alias("q")), "divergence-cells")
    release(counts, kept, cells, plain)
    return langs, groups, out


def _children(rows: DataFrame, column: str, end: Column) -> DataFrame:
    """Each node's K children along an axis, as far as `end` (exclusive)."""
    first = F.col(column) * K
    return rows.withColumn("_end", F.least(first + K, end)).where(first < F.col("_end")).withColumn(column, F.explode(F.sequence(first, F.col("_end") - 1))).drop("_end")


def walk(langs: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, priced): pairs of leaves (lang, a, b, c, width) of row blocks a <= b and column block c of which one has
    counts, and (lang, a, b, width), the columns of all quadrants in which neither has any.

    The tree's upper nodes are the leaves' coordinates divided by K. All pairs go down from the root together; a pair of
    quadrants without counts is priced where it is met, its columns never walked."""
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    sized = langs.select("lang", "terms", blocks("rows", LEAF_ROWS).alias("_rows"), blocks("terms", LEAF_TERMS).alias("_cols"))
    most = sized.agg(F.max(F.greatest("_rows", "_cols"))).first()[0] or 0
    height = next(h for h in range(64) if K**h >= most)
    zero = [F.lit(0).cast("long").alias(c) for c in ("a", "b", "c")]
    at = stored(sized.select("*", *zero, F.lit(None).cast("long").alias("width")), "divergence-walk")
    for h in range(height, -1, -1):
        if h < height:
            rows, cols = F.ceil(F.col("_rows") / K**h).cast("long"), F.ceil(F.col("_cols") / K**h).cast("long")
            both = _children(_children(at, "a", rows), "b", rows).where("a <= b")
            # Priced pairs are split by rows alone, so that they end as pairs of row blocks.
            at = _children(both.where("width IS NULL"), "c", cols).unionByName(both.where("width IS NOT NULL"))
        span = LEAF_TERMS * K**h
        nodes = stored(leaves.select("lang", F.floor(F.col("a") / K**h).alias("a"), F.floor(F.col("c") / K**h).alias("c")).distinct(), "divergence-nodes")
        for side in ("a", "b"):
            at = _meet(at, nodes.select("lang", F.col("a").alias(side), "c", F.lit(True).alias(f"has_{side}")), ["lang", side, "c"], "left")
        empty = F.col("width").isNull() & F.col("has_a").isNull() & F.col("has_b").isNull()
        own = F.greatest(F.least(F.col("terms") - F.col("c") * span, F.lit(span)), F.lit(0))
        at = at.withColumn("width", F.when(empty, own).otherwise(F.col("width"))).drop("has_a", "has_b")
        shut = at.where("width IS NOT NULL").groupBy("lang", "terms", "_rows", "_cols", "a", "b").agg(F.sum("width").alias("width")).withColumn("c", F.lit(0).cast("long"))
        at = stored(at.where("width IS NULL").unionByName(shut), "divergence-walk")
        release(nodes)
    live = at.where("width IS NULL").withColumn("width", F.least(F.col("terms") - F.col("c") * LEAF_TERMS, F.lit(LEAF_TERMS)))
    return live.select("lang", "a", "b", "c", "width"), at.where("width IS NOT NULL").select("lang", "a", "b", "width")


def distances(langs: DataFrame, groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, i, j, value) of each pair of rows i < j of a language: the sum of |p_i - p_j| over all kept terms."""
    a, r = F.floor(F.col("row") / LEAF_ROWS).alias("a"), (F.col("row") % LEAF_ROWS).cast("int").alias("r")
    # At most LEAF_ROWS * LEAF_TERMS cells are one leaf, LEAF_ROWS groups one block.
    leaves = stored(cells.groupBy("lang", a, F.floor(F.col("col") / LEAF_TERMS).alias("c")).agg(F.collect_list(F.struct(r, (F.col("col") % LEAF_TERMS).cast("int").alias("t"), "p")).alias("cells")), "divergence-leaves")
    heads = stored(groups.groupBy("lang", a).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "p0"))), lambda x: x["p0"]).alias("p0")), "divergence-heads")
    live, priced = walk(langs, leaves)
    none = F.lit(None).cast(leaves.schema["cells"].dataType)
    for side in ("a", "b"):
        live = live.join(leaves.select("lang", F.col("a").alias(side), "c", F.col("cells").alias(f"cells_{side}")).hint("merge"), ["lang", side, "c"], "left")
    pairs = live.drop("c").unionByName(priced.withColumns({"cells_a": none, "cells_b": none}))
    for side in ("a", "b"):
        pairs = _meet(pairs, heads.select("lang", F.col("a").alias(side), F.col("p0").alias(f"p0_{side}")), ["lang", side])

    def tile(p0: np.ndarray, cells: pa.StructArray, width: int) -> np.ndarray:
        out = np.repeat(p0[:, None], width, axis=1)
        if len(cells):
            at, t, p = (cells.field(x).to_numpy() for x in ("r", "t", "p"))
            out[at, t] = p
        return out

    def run(batches):
        for batch in batches:
            sums: dict[tuple, np.ndarray] = {}
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for i, (lang, a, b, width) in enumerate(zip(*(column[c].to_pylist() for c in ("lang", "a", "b", "width")), strict=True)):
                p, q = (column[f"p0_{s}"][i].values.to_numpy() for s in ("a", "b"))
                lists = [column[f"cells_{s}"][i].values for s in ("a", "b")]
                if lists[0] is None and lists[1] is None:  # no counts on either side: every column is alike
                    value = width * np.abs(p[:, None] - q[None, :])
                else:
                    x, y = (tile(p0, own if own is not None else [], width) for p0, own in ((p, lists[0]), (q, lists[1])))
                    value = np.stack([np.abs(y - row).sum(1) for row in x])
                sums[lang, a, b] = sums[lang, a, b] + value if (lang, a, b) in sums else value
            for (lang, a, b), value in sums.items():
                i, j = np.triu_indices(len(value), 1) if a == b else (x.ravel() for x in np.indices(value.shape))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(i + a * LEAF_ROWS, pa.int64()), "j": pa.array(j + b * LEAF_ROWS, pa.int64()), "value": pa.array(value[i, j], pa.int64())})

    return map_texts(pairs, run, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others (part `pair`, every
    rank) and the terms it holds more of than the language (part `term`, `top` ranks).

    A term is a run of letters (A-Z made small, every character beyond ASCII is one), kept in a language if at least
    `least_docs` of its documents hold it; shares are whole billionths, smoothed by PRIOR, so all sums are exact. Null
    text, lang or source: ''. A group without terms is a group; a language without kept terms has distances of 0; a source
    alone in its language has no pairs. Ties rank by the item's bytes. Repeated rows count each time. Empty table: empty
    result. Very long texts count whole. Other columns are not read."""
    langs, groups, cells = matrix(documents, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ends = stored(distances(langs, groups, cells), "divergence-pairs")
    ends = ends.select("lang", "i", "j", "value").unionByName(ends.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    for row, name in (("i", "source"), ("j", "item")):
        ends = _meet(ends, groups.select("lang", F.col("row").alias(row), F.col("source").alias(name)), ["lang", row])
    pairs = ends.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).withColumn("rank", F.col("rank").cast("int"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (v.n + 5 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM m WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
