"""What happens beyond the bounds up to which tables are broadcast: the same rows by another plan."""

import random

import numpy as np
from pyspark.sql import functions as F

from dealspark.llm import langid, mixing, quality_rules, simhash, warc

R = random.Random(7)
WORDS = [f"w{i}" for i in range(60)]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def documents(spark):
    rows = [(i, " ".join(R.choices(WORDS[i % 3 * 20 : i % 3 * 20 + 25], k=70)), ["en", "fr"][i % 2], f"s{i % 4}", 1) for i in range(60)]
    return spark.createDataFrame([*rows, rows[3], (None, "x", None, None, 1), (99, None, "en", None, 1)], "doc_id long, text string, lang string, source string, copies int")


def test_more_labels_than_are_broadcast(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (1, 1)], "doc_id long, quality int")
    assert rows_of(quality_rules.quality_rules(docs, labels, broadcast_ids=0)) == rows_of(quality_rules.quality_rules(docs, labels))


def test_more_revisits_than_are_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://x.org", f"page {i % 5}" if i % 7 else None) for i in range(40)] + [(3, "u", "page 3"), (None, "u", "page 3")], "page_id long, url string, html string")
    few = rows_of(warc.archive_pages(pages))
    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", 0)
    assert rows_of(warc.archive_pages(pages)) == few and len(few) == 42


def test_a_component_of_more_than_its_share_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_HOT", 1)
    gray = np.arange(1500) ^ (np.arange(1500) >> 1)  # each differs from the next by one bit
    far = [(5000 + i, int(x)) for i, x in enumerate((0x7F00FF00FF00FF00, 0x00FF00FF00FF0000))]
    prints = spark.createDataFrame([(int(i) + 10, int(x)) for i, x in enumerate(gray)] + far, "doc_id long, _fp long")
    got = {r["_fp"]: r["_component"] for r in simhash.classes(prints).collect()}
    assert {got[int(x)] for x in gray} == {10} and [got[x] for _, x in far] == [5000, 5001] and len(got) == 1502


def test_more_languages_than_are_broadcast(spark, monkeypatch):
    docs = documents(spark)
    few = langid.training_rows(docs)
    monkeypatch.setattr(langid, "MAX_BROADCAST_LANGS", 0)
    assert langid.training_rows(docs) == few and len(few) > 20


def test_the_count_of_a_mix_takes_a_free_name(spark):
    docs = documents(spark)
    out = mixing.mixed_documents(docs, count="taken")
    assert out.columns == [*docs.columns, "taken"] and {r["copies"] for r in out.collect()} == {1}
    assert rows_of(out.select("doc_id", F.col("taken").alias("copies"))) == rows_of(mixing.mixed_documents(docs).select("doc_id", "copies"))
