"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

BUCKETS, SMOOTHING, THRESHOLD, BROADCAST_IDS = 1 << 14, 1.0, -0.1, 200_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where a lambda in body uses it."""
    return F.transform(F.array(value), body)[0]


def grams(words: Column, n: Column) -> Column:
    """Buckets of the unigrams and bigrams of a column of words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    two = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(BUCKETS)))
    return F.when(n >= 2, F.concat(one, two)).otherwise(one)


def bucket_counts(documents: DataFrame) -> dict[int, int]:
    words = documents.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words")).withColumn("n", F.size("words"))
    return dict(words.select(F.explode(grams(F.col("words"), F.col("n"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect())


def log_ratios(documents: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> list[float]:
    """log(p_target / p_raw) of every bucket.

    Raw counts are over all of documents; the trusted target is all of those whose label quality is 1. Up to broadcast_ids
    counted ids are broadcast, more meet the documents in a shuffle; the counts are the same. BUCKETS numbers come to the
    driver whatever the input's size.
    """
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(broadcast_ids + 1).count() <= broadcast_ids else ids.hint("merge")
    raws, targets = bucket_counts(documents), bucket_counts(documents.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    raw, target = sum(raws.values()), sum(targets.values())
    import math

    spread = SMOOTHING * BUCKETS
    ratio = lambda t, r: math.log((t + SMOOTHING) / (target + spread)) - math.log((r + SMOOTHING) / (raw + spread))
    return [ratio(targets.get(b, 0), raws[b]) if b in raws else 0.0 for b in range(BUCKETS)] if target else [0.0] * BUCKETS


def repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that are found twice or more, from the windows' 64-bit hashes.

    Sorted hashes show whether any repeats; only then are (hash, place) pairs sorted and the places' cover summed up, so
    the cost is n log n for any text.
    """

    def places(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        flagged = F.transform(s, lambda x, i: F.when(F.when(i > 0, same(x, i)).otherwise(F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), x["i"]))
        return F.sort_array(F.filter(flagged, lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = let(F.sort_array(hashes), lambda s: F.exists(F.transform(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False))), lambda x: x))
    return F.when(repeated, let(let(pairs, places), cover)).otherwise(0).cast("long")


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) for every row.

    llr is the mean log-likelihood ratio of the text's unigrams and bigrams; a text is kept if it doesn't fail the base
    rules and llr >= threshold. Null and empty texts have no words, so they fail; without trusted documents every llr is
    0, and the base rules alone decide. Counts are summed on the map side, and the table of ratios (BUCKETS numbers) is a
    literal; texts are shuffled only to find the trusted ones among more than broadcast_ids labels. Null or repeated ids: a row each. Extra columns are not read.
    """
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(documents, labels, broadcast_ids)))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    df = documents.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    w = F.col("words")
    df = df.select("*", F.size("words").alias("n"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    total = F.aggregate(grams(w, F.col("n")), F.lit(0.0), lambda a, b: a + F.get(ratios, b.cast("int")))
    count = F.when(F.col("n") >= 2, 2 * F.col("n") - 1).otherwise(F.col("n"))
    df = df.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("n") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"), F.coalesce(F.try_divide(total, count), F.lit(0.0)).alias("llr"),
    )
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", let(F.col("windows"), repeat_words).alias("n_repeat_words"), "llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")
