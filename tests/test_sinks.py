"""Sinks and landing: what is written is read back, a replay adds nothing, a failing sink blocks no other."""

import pytest

from dealspark.operators import dedup
from dealspark.sources import sinks
from dealspark.streaming import streams


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "line\tü"), (3, None)], "id long, text string")
    sinks.write_jsonl(df, f"{tmp_path}/j")
    sinks.write_jsonl(df.limit(1), f"{tmp_path}/j")
    assert spark.read.schema(df.schema).json(f"{tmp_path}/j").count() == 4
    for _ in range(2):  # the second replaces the first
        sinks.write_csv(df, f"{tmp_path}/c")
    got = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_fan_out_gives_every_sink_the_batch_and_raises_the_first_failure(spark):
    seen = []

    def broken(batch, batch_id):
        raise ValueError("first")

    run = sinks.foreach_batch_fanout([broken, lambda b, i: seen.append((i, b.count()))])
    with pytest.raises(ValueError, match="first"):
        run(spark.range(3), 7)
    assert seen == [(7, 3)]


def test_landing_a_batch_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("chat", "1", "a"), ("chat", "1", "b"), ("mail", "1", "c")], "source string, source_id string, body string")
    rows.limit(0).write.parquet(f"{tmp_path}/t")
    land = streams.foreach_land(f"{tmp_path}/t", rows.schema)
    for batch_id in (0, 0, 1):
        land(rows, batch_id)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_status_counts_and_stages(spark):
    rows = spark.createDataFrame([(1, "raw"), (2, "raw"), (3, "normalized")], "id long, status string")
    assert {r["status"]: r["n"] for r in streams.stream_status(rows).collect()} == {"raw": 2, "normalized": 1}
    assert [r["id"] for r in streams.stage_stream(rows, "normalized", lambda d: d).collect()] == [3]


def test_people_without_names_or_keys_link_to_no_one_and_items_without_a_hash_stay(spark):
    schema = "id string, name string, slug string, email string, phone string, companies array<string>, threads array<string>, degree long"
    rows = [("a", None, None, None, None, None, None, None), ("b", None, None, None, None, ["x"], ["t"], 0), ("c", "Asha Rao", None, None, None, ["x"], [], 1), ("d", "Asha", None, None, None, ["x"], [], 0), ("e", "asha rao", "s1", None, None, ["x"], [], 2), ("f", "Asha Rao", "s2", None, None, ["y"], [], 2)]
    links = {(r["a"], r["b"]) for r in dedup.person_links(spark.createDataFrame(rows, schema)).collect()}
    assert {x for pair in links for x in pair} == {"c", "d", "e"}
    items = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "id long, content_hash string")
    assert {r["id"]: r["original"] for r in dedup.inherit_notes(items).collect()} == {1: 1, 2: 1, 3: 3}
