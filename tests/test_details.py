"""Boards, actions, deletes, attributes, numbering and figures on null, empty, repeated and hot input."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from dealspark.operators import gold, knowledge, numbering, profiles, upsert, views
from dealspark.sources import raw


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers_within_a_key_are_those_of_one_window(spark):
    rows = [(["hot", None, "a", "b"][0 if i % 3 == 0 else i % 4], i * 7919 % 1000) for i in range(900)]
    df = frame(spark, rows, "k string, v int").repartition(6)
    got = {(r["k"], r["v"]): r["n"] for r in numbering.numbered(df, ["k"], ["v"]).collect()}
    for k in ("hot", None, "a", "b"):
        own = sorted(v for x, v in rows if x == k)
        assert [got[k, v] for v in own] == list(range(1, len(own) + 1))
    down = numbering.numbered(df, ["k"], [F.desc("v")]).where("k = 'hot' AND n = 1").first()["v"]
    assert down == max(v for k, v in rows if k == "hot") and numbering.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_a_hot_key_is_numbered_by_several_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    out = numbering.numbered(df, ["k"], ["id"])
    assert out.agg(F.max("n"), F.countDistinct("n")).first() == (20_000, 20_000)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, the ranges stay apart
    try:
        assert df.repartitionByRange("k", "id").groupBy(F.spark_partition_id()).count().count() > 1
        assert numbering.numbered(df, ["k"], [F.desc("id")]).agg(F.max("n"), F.countDistinct("n")).first() == (20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_actions(spark):
    companies = frame(spark, [("c1", "Sourced", None), ("c2", None, "old"), (None, None, None)], "id string, pipeline_stage string, deal_owner string")
    tasks = frame(spark, [(1, "open"), (2, "open"), (2, "open")], "id long, status string")
    acts = frame(spark, [("c1", "stage", "Won", 1), ("c1", "stage", "Bad", 2), ("c2", "owner", "me", 1), ("c2", "owner", None, 2), ("c9", "stage", "Won", 1), ("2", "done", None, 1), (None, "done", None, 1), ("1", None, "x", 1)], "target string, what string, value string, seq int")
    own, done = upsert.apply_updates(companies, tasks, acts, ["Sourced", "Won"])
    assert sorted(map(tuple, own.collect()), key=str) == sorted([("c1", "Won", None), ("c2", None, "old"), (None, None, None)], key=str)
    assert sorted(map(tuple, done.collect())) == [(1, "open"), (2, "done"), (2, "done")]


def test_deletes_are_guarded_and_spare_entities(spark):
    e = frame(spark, [(1, "pdf", 11), (2, "gmail", 12), (3, "pdf", None), (4, "pdf", 14)], "id long, source string, raw_id long")
    tables = {
        "envelope": e, "raw": frame(spark, [(11, "r1"), (12, "r2"), (14, None), (99, "r9")], "id long, storage_ref string"), "attachment": frame(spark, [(1, "r1"), (1, "a1"), (2, "a2")], "envelope_id long, storage_ref string"),
        "chunk": frame(spark, [(1,), (1,), (2,), (None,)], "envelope_id long"), "entity": frame(spark, [("x",)], "id string"),
    }
    wanted = frame(spark, [(1,), (1,), (2,), (3,), (7,), (None,)], "envelope_id long")
    left, report = upsert.delete_documents(tables, wanted)
    assert {r["id"] for r in left["envelope"].collect()} == {2, 4} and {r["id"] for r in left["raw"].collect()} == {12, 14, 99}
    assert left["chunk"].count() == 2 and left["attachment"].count() == 1 and left["entity"].count() == 1
    assert {r["envelope_id"]: (r["removed"], r["reason"], r["refs"]) for r in report.collect()} == {1: (True, None, ["a1", "r1"]), 2: (False, "not of source pdf", []), 3: (True, None, []), 7: (False, "not found", []), None: (False, "not found", [])}
    again, second = upsert.delete_documents(left, wanted)
    assert again["envelope"].count() == 2 and not second.where("removed").count()


def test_attributes_of_notes(spark):
    schema = "id long, occurred_at date, company_name string, round_type string, ask double, sector string, hq string, founders array<struct<name:string,role:string,linkedin:string>>"
    rows = [(1, date(2024, 1, 1), "Acme", "Seed", None, "Old", "Pune", [("Asha Rao", "CEO", "u"), ("Team", "x", None)]), (2, date(2024, 2, 1), "Acme ", "Seed", 5.0, "New", None, [("Asha Rao", None, None)]), (3, None, "n/a", None, None, "x", None, None), (4, date(2024, 1, 1), None, None, None, None, None, [])]
    got = {(r["type"], r["canonical"]): r["attrs"] for r in knowledge.fan_out_attributes(frame(spark, rows, schema)).collect()}
    assert got["company", "Acme"] == {"sector": "New", "hq": "Pune"} and got["person", "Asha Rao"] == {"role": "CEO", "company": "Acme ", "linkedin": "u", "relation": "founder"}
    assert got["deal", "Acme — Seed"]["status"] == "active" and set(got) == {("company", "Acme"), ("person", "Asha Rao"), ("deal", "Acme — Seed"), ("deal", "Acme  — Seed")}


def test_sketches_add_up_and_keep_their_bound(spark):
    log = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("at"), F.lit("skipped").alias("status"), (F.col("id") % 9000).cast("string").alias("content_hash"), F.lit(1).cast("decimal(9,2)").alias("usd"))
    got = {r["source"]: r for r in gold.ops_figures(gold.ops_sketches(log), "2024-01-05").collect()}
    for source, n, distinct in (("hot", 10_000, 3000), ("b", 20_000, 6000)):
        assert abs(got[source]["collision_rate"] - (1 - distinct / n)) < 4 * 1.04 / 64 * distinct / n and got[source]["n"] == n and got[source]["skip_rate"] == 1.0
    parts = gold.ops_sketches(log.where("at < '2024-01-03'")).unionByName(gold.ops_sketches(log.where("at >= '2024-01-03'")))
    assert sorted(map(tuple, gold.ops_figures(parts, "2024-01-05").collect())) == sorted(map(tuple, got.values()))
    odd = frame(spark, [(None, None, None, None, None), ("x", None, "raw", None, None)], "source string, at date, status string, content_hash string, usd decimal(9,2)")
    assert {r["source"]: (r["queued"], r["collision_rate"]) for r in gold.ops_figures(gold.ops_sketches(odd), "2024-01-05").collect()} == {None: (0, 1.0), "x": (1, 1.0)}


def test_exports_and_lists(spark):
    card = frame(spark, [("A", "banking, software", None, True), ("B", None, 1.0, False), ("C", "x", None, None)], "company_name string, sector string, ask double, has_deal boolean")
    people, log = frame(spark, [("P", None, None, None)], "canonical string, role string, company string, linkedin string"), frame(spark, [("f", "d", "A", None), ("g", "d", "A", "pdf")], "file string, date string, company string, source string")
    out = views.index_exports(card, people, log)
    assert {k: v.count() for k, v in out.items()} == {"companies": 3, "deals": 1, "pipeline": 2, "people": 1, "log": 2}
    assert out["deals"].first()["sectors"] == ["Fintech", "SaaS"] and {r["meeting_type"] for r in out["log"].collect()} == {"Call", "Deck"}
    docs = frame(spark, [("c", str(i), f"2024-01-{1 + i % 5:02d}" if i % 6 else None, "k", "t") for i in range(50)], "company_id string, filing_id string, filing_date string, kind string, title string")
    got = views.note_filings(docs).collect()
    assert len(got) == 40 and {r["more"] for r in got} == {10} and [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(1, 41))
    placed = frame(spark, [("e2", "Won", "me"), ("e3", None, "me")], "entity_id string, pipeline_stage string, deal_owner string")
    cards = frame(spark, [("e1", "A", True, 1.0), ("e2", "B", False, None), ("e3", "C", False, None), (None, "D", True, None)], "entity_id string, company_name string, has_deal boolean, ask double")
    assert {r["company_name"]: r["stage"] for r in gold.placed_pipeline(cards, placed).collect()} == {"A": "Sourced", "B": "Won", "D": "Sourced"}


def test_profiles_from_files(spark, tmp_path):
    one, many = {"firstName": "Asha", "lastName": "Rao", "nested": {"a": [1]}}, [{"firstName": "B"}, {"firstName": "C"}, 5]
    (tmp_path / "a.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(many, indent=2))
    got = raw.read_profile_texts(spark, str(tmp_path))
    assert sorted(json.loads(r["json"])["firstName"] for r in got.collect()) == ["Asha", "B", "C"]
    assert profiles.parse_profile(got.withColumn("id", F.lit(1)), "id").where("name = 'Asha Rao'").count() == 1
    (tmp_path / "c.json").write_text(json.dumps(many[:2], indent=2))
    assert {r["firstName"] for r in raw.read_profiles(spark, str(tmp_path / "c.json")).collect()} == {"B", "C"}


def test_rows_by_kind(spark):
    rows = frame(spark, [("Company",), (" document ",), (None,), ("",), ("x",)], "kind string")
    assert {k: df.count() for k, df in raw.by_kind(rows).items()} == {"company": 3, "document": 1, "skipped": 1}


def test_internal_people_keep_their_first_company(spark):
    m = frame(spark, [("a", None, "c1", 1, 1), ("a", "CEO", "c2", 2, 2), ("b", None, "c1", 1, 3), ("b", None, "c2", 2, 4), (None, None, "c3", 1, 5)], "person string, role string, company string, at int, id int")
    got = {r["person"]: (r["role"], r["company"]) for r in gold.merge_people(m, frame(spark, [("a",), ("a",)], "person string")).collect()}
    assert got == {"a": ("CEO", "c1"), "b": (None, "c2"), None: (None, "c3")}
    with pytest.raises(Exception, match="person"):
        gold.merge_people(m.drop("person")).count()
