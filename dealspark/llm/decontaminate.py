"""Benchmark decontamination by a broadcast set of hashed windows, verified word by word."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_texts, named, stored, typed

#: Bytes of lower-cased UTF-8: digits, letters a to z and all that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the benchmark in one broadcast; a larger benchmark is scanned in blocks, one after the other.
BLOCK_CHARS = 16 << 20
HITS = "_n_words long, _hits array<struct<a:int,b:int>>, _items array<string>"


class Windows:
    """The windows of some benchmark items: their words' ids end to end, and for each length the sorted hashes of windows
    and where they begin; of windows alike within an item one is kept."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        texts = [[self.ids.setdefault(w, len(self.ids) + 1) for w in WORD.findall(text.lower())] for _, text in items]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(np.concatenate([[0], sizes[:-1]])) if len(sizes) else np.zeros(0, np.int64)
        self.words = np.fromiter((i for t in texts for i in t), np.int32, int(sizes.sum()))
        self.tables = {}
        length = np.minimum(sizes, n)
        for k in np.unique(length[length > 0]).tolist():
            first = np.concatenate([np.arange(self.starts[i], self.starts[i] + sizes[i] - k + 1) for i in np.flatnonzero(length == k)])
            hashes = rolling(self.words, k)[first]
            order = np.lexsort((first, hashes))
            hashes, first = hashes[order], first[order]
            owner = self.owner(first)
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
            same = np.flatnonzero(~new)  # equal hashes of one item are dropped only if the words are equal too
            new[same[[bool((self.words[first[i] : first[i] + k] != self.words[first[i - 1] : first[i - 1] + k]).any()) for i in same]]] = True
            self.tables[k] = hashes[new], first[new].astype(np.int32)

    def owner(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, first, side="right") - 1


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of k ids."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    wide = ids.astype(np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * BASE + wide[j : j + n] + np.uint64(1)
    return out ^ (out >> np.uint64(31))


def find_hits(w: Windows, ids: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(first word, length, item) of each occurrence, verified word by word; ids: 0 for a word that no item has."""
    for k, (hashes, first) in w.tables.items():
        got = rolling(ids, k)
        at = np.searchsorted(hashes, got)
        at[at == len(hashes)] = 0
        for i in np.nonzero(hashes[at] == got)[0]:
            j = int(at[i])
            while j < len(hashes) and hashes[j] == got[i]:
                if (w.words[first[j] : first[j] + k] == ids[i : i + k]).all():
                    yield int(i), k, w.items[int(w.owner(first[j]))]
                j += 1


def _scan(df: DataFrame, shared, only_hits: bool = False) -> DataFrame:
    """Every column of df and HITS, by one broadcast of windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch, texts in blocks(batches, "text"):
            ids, starts = [0], []
            for t in texts:
                starts.append(len(ids))
                ids += [w.ids.get(x, 0) for x in WORD.findall(t.lower())]
                ids.append(0)  # no window crosses it
            starts.append(len(ids))
            hits, found = [[] for _ in texts], [set() for _ in texts]
            for i, k, item in find_hits(w, np.array(ids, dtype=np.int32)):
                row = int(np.searchsorted(starts, i, side="right")) - 1
                hits[row].append((i - starts[row], i - starts[row] + k))
                found[row].add(item)
            n = pa.array([b - a - 1 for a, b in zip(starts, starts[1:], strict=False)], pa.int64())
            spans = pa.array([union(h) for h in hits], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            out = pa.RecordBatch.from_arrays([*batch.columns, n, spans, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], [*batch.schema.names, "_n_words", "_hits", "_items"])
            yield out.filter(pa.array([bool(h) for h in hits])) if only_hits else out

    return map_texts(df, run, typed(df, HITS))


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each _row: its spans' union and all its items, as many as its own text gives."""
    rows = parts.groupBy("_row").agg(F.max("_n_words").alias("_n_words"), F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([union([(x["a"], x["b"]) for x in h]) for h in batch.column(2).to_pylist()], batch.schema.field(2).type)
            yield batch.set_column(2, "_hits", spans)

    return map_texts(rows, run, typed(rows))


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every column of documents and _n_words, _hits (array of word positions [first, behind)), _items (array of item ids).

    The benchmark's size is measured first. Up to block_chars it is one broadcast, scanned against all documents without
    a shuffle. Beyond that the documents are numbered and written, and blocks of about block_chars (a larger item is one
    of its own) are broadcast, scanned and written one after the other, so that one block is in memory at a time; their
    narrow hits are merged and meet the documents by number. Names with a leading underscore are reserved for the result.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("item").isNotNull())
    parts = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1

    def block(part: int):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        whole: dict[str, list[bytes]] = {}
        for r in own:
            whole.setdefault(r["item"], []).append(r["text"].encode())
        return spark.sparkContext.broadcast(Windows([(item, t) for item in sorted(whole) for t in sorted(whole[item])], n))

    if parts == 1:
        return _scan(documents, block(0))
    rows, found = stored(documents.withColumn("_row", F.monotonically_increasing_id()), "numbered"), None
    for part in range(parts):
        shared = block(part)
        some = stored(_scan(rows.select("_row", "text"), shared, only_hits=part > 0).drop("text"), "hits")  # the first counts all words
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    merged = stored(_merged(found), "merged-hits").withColumnRenamed("_row", "_r")
    return rows.join(merged.hint("merge"), F.col("_row") == F.col("_r")).drop("_row", "_r")


def union(spans: list[tuple[int, int]]) -> list[dict]:
    """The spans' union, as structs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row.

    Null and empty texts have no words; an empty benchmark hits nothing. Null or repeated ids: a row each. Items with a
    null id are left out, rows of one item id count as one item.
    """
    found = scan(documents.select("doc_id", "text"), benchmark, n)
    hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and what stands between them; what is left is joined by a space."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data.lower())]
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : words[a][0]])
        at = words[b - 1][1]
    parts.append(data[at:])
    return b" ".join(p.strip() for p in parts if p.strip()).decode("utf-8", "replace")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5) -> DataFrame:
    """documents without benchmark passages: hit spans go, and whole documents of which drop_share or more was hit.

    Columns stay as they are, whatever their names; other texts are unchanged byte by byte. Null texts stay.
    """
    names = [c for c in documents.columns if c != "text"]
    rest = F.struct(F.lit(0).alias("_"), *[named(c).alias(f"c{i}") for i, c in enumerate(names)])  # packed, so that no name clashes
    found = scan(documents.select("text", rest.alias("doc")), benchmark, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for t, h, k in zip(cols["text"].to_pylist(), cols["_hits"].to_pylist(), cols["_n_words"].to_pylist(), strict=True):
                spans = [(x["a"], x["b"]) for x in h]
                gone = sum(b - a for a, b in spans)
                keep.append(not gone or gone < drop_share * k)
                texts.append(cut(t, spans) if gone and keep[-1] else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), cols["doc"]], ["text", "doc"]).filter(pa.array(keep, pa.bool_()))

    out = map_texts(found, run, found.select("text", "doc").schema)
    return out.select(*["text" if c == "text" else F.col(f"doc.c{names.index(c)}").alias(c) for c in documents.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
