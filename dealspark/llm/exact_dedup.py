"""Exact dedup: groups by a 128-bit content hash, one stable id kept of each, bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, release, stored

#: Groups of copies (counted) up to which their table is broadcast; more meet the rows in a merge join.
MAX_BROADCAST_GROUPS = 200_000


def content_hash(body: Column) -> Column:
    """16 bytes of a text's UTF-8."""
    return F.unhex(F.md5(body.cast("binary")))


def same(text: Column) -> Column:
    """No change before texts are compared."""
    return text


def _meet(rows: DataFrame, groups: DataFrame, small: bool, how: str) -> DataFrame:
    """A join on the digests of the side that has one row for each group; both sides lie behind plain exchanges, so that
    a hot group's partition is split."""
    return rows.join(F.broadcast(groups) if small else groups.hint("merge"), [c for c in ("h", "sha") if c in groups.columns], how)


def _grouped(documents: DataFrame, keep: str, normal: Callable[[Column], Column], digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, groups, small): a narrow row of each document (doc_id, h, sha, row); the groups of two or more, proven by
    their bytes (h, sha, group_size, last); whether these are few enough to broadcast."""
    body = normal(F.coalesce("text", F.lit("")))
    rows = stored(documents.select("doc_id", digest(body).alias("h"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-rows")
    # A null id stays only where there is no other.
    if keep == "largest":
        stays = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row"))
    else:
        stays = F.min(F.struct(F.col("doc_id").isNull().alias("has"), "doc_id", "row"))
    groups = stored(rows.groupBy("h", "sha").agg(F.count("*").alias("group_size"), stays.alias("last")).where("group_size > 1"), "exact-groups")
    small = groups.count() <= MAX_BROADCAST_GROUPS
    texts = documents.select(digest(body).alias("h"), body.cast("binary").alias("bytes"))
    if small:  # else every text is dealt by its hash, copies within a task once
        texts = _meet(texts, groups.select("h").distinct(), True, "left_semi")
    # Whole texts are the grouping key: of the copies in a task one is moved, and a hot group is as many rows as tasks.
    found = texts.groupBy("h", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("h", F.unhex(F.sha2("bytes", 256)).alias("sha"), "n")
    proof = found.groupBy("h", "sha").agg(F.max("n").alias("n"), F.count("*").alias("texts"))
    proof = groups.select("h", "sha", "group_size").join(proof.hint("merge"), ["h", "sha"], "full")
    if wrong := proof.where("texts IS NULL OR group_size IS NULL OR texts > 1 OR n <> group_size").count():
        raise ValueError(f"{wrong} groups hold texts of other bytes under both digests, or documents changed between two reads")
    return rows, groups, small


def exact_groups(documents: DataFrame, keep: str = "smallest", normal: Callable[[Column], Column] = same, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of documents.

    Documents whose `normal`ised texts have the same bytes are a group; its row of the `smallest` or `largest` id is kept.
    `digest` parts the rows; texts that share it by chance are told apart by their SHA-256, and each group's bytes are
    compared (each text is moved once a task, and only those of groups if these are few). Only two texts equal in both
    digests can't be told apart; that raises an error.

    Null text: as the empty text, all of them one group. Null ids stay only in groups without another id. Rows alike in id
    and text: one of them stays. Empty table: empty result. Very long texts: hashed and compared whole. Other columns are
    not read."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows, groups, small = _grouped(documents, keep, normal, digest)
    out = _meet(rows, groups, small, "left")
    alone = F.col("last").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("last.row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(documents: DataFrame, keep: str = "smallest", normal: Callable[[Column], Column] = same, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The kept rows of documents with all their columns, whatever these are called; cases as in `exact_groups`.

    Of rows alike in id and text but not in other columns the one whose other values hash highest stays."""
    rows, groups, small = _grouped(documents, keep, normal, digest)
    release(rows)
    body = normal(F.coalesce("text", F.lit("")))
    packed = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(documents.columns)])
    rows = documents.select("doc_id", digest(body).alias("h"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), packed.alias("doc"))
    single = _meet(rows, groups, small, "left_anti").select("doc")
    heads = _meet(rows, groups.select("h", "sha", F.col("last.doc_id").alias("keep_id")), small, "inner").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    heads = heads.groupBy("h", "sha").agg(F.max_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc")).select("doc")
    return single.unionByName(heads).select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(documents.columns)])


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, coalesce(g.keep_id, d.doc_id) AS keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
