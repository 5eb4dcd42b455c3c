"""Dispatch, decisions, automaton, publishing and streams with state: odd input, and streams equal to their batch twins
whatever the batches."""

import json
import threading
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealspark.functions import rules as R
from dealspark.operators import dispatch, gold, matching, normalize
from dealspark.sources import publish
from dealspark.streaming import stateful, streams


def batches_of(spark, tmp_path, rows, schema, cuts, name="in"):
    """A stream that gives rows in micro-batches cut at these places, one file each."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/p{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")


def drain(df, tmp_path, name="out"):
    streams.run_available(df, f"{tmp_path}/{name}", f"{tmp_path}/{name}-log")
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")


def rows_of(df):
    return sorted(map(repr, df.collect()))


ITEMS = [
    ("whatsapp", "1", {"id": "m", "type": "document", "document": {"caption": "see", "sha256": "s"}, "chat_id": "c", "timestamp": 1700000000, "from_me": True}),
    ("whatsapp", "2", {"id": "m2", "type": "image", "image": {"id": "i"}}), ("whatsapp", "3", {"text": {"body": "x" * 200_000}}),
    ("gmail", "4", {"id": "g", "threadId": "t", "internalDate": "1700000000123", "labelIds": ["CATEGORY_UPDATES", "X", "Call Notes"], "given_labels": ["deal-flow"], "payload": {"headers": [{"name": "SUBJECT", "value": "Hi"}], "parts": [{"filename": ""}, {"filename": "a.pdf"}]}}),
    ("gmail", "5", {"Subject": "flat", "from": "a@x.org", "Date": "2024-01-02T00:00:00Z", "body_text": "b"}),
    ("calendar", "6", {"id": "e", "start": {"date": "2024-01-02"}, "attendees": [{"email": "room@resource.calendar.google.com"}, {}], "description": "agenda -::~\nmeet ~::-"}),
    ("drive_doc", "7", {"id": "f", "mimeType": dispatch.NATIVE[0], "exportedText": "t", "modifiedTime": "2024-01-02T00:00:00Z"}), ("pdf", "8", {"title": "T"}), ("dashboard", "9", {"b": 1, "a": {"d": 1, "c": None}, "name": "N"}),
    ("odd", "10", {"z": 1, "y": [1]}), (None, "11", {"body": "b"}), ("gmail", "12", []), ("pdf", "13", 3), ("gmail", None, {"id": "n"}),
]


def test_each_item_reaches_its_mapper(spark):
    raw = [(s, i, json.dumps(p), "kept", "clash") for s, i, p in ITEMS] + [("gmail", "20", "{bad", "kept", "clash"), ("x", "21", None, "kept", "clash"), ("x", "21", None, "kept", "clash")]
    df = dispatch.map_items(spark.createDataFrame(raw, "source string, source_id string, payload string, extra string, title string"))
    got = {r["source_id"]: r for r in df.collect() if r["source_id"] != "21"}
    assert df.count() == len(raw) and all(r["extra"] == "kept" for r in got.values())
    assert (got["1"]["body_raw"], got["1"]["labels"], got["1"]["has_attachment"], got["1"]["thread"]) == ("see", ["internal"], True, "c")
    assert got["2"]["body_raw"] == "" and len(got["3"]["body_raw"]) == 200_000 and got["2"]["content_hash"] == spark.sql("SELECT sha2('i', 256)").first()[0]
    assert got["4"]["labels"] == ["deal-flow", "newsletter", "call-notes"] and got["4"]["title"] == "Hi" and got["4"]["has_attachment"] and got["4"]["occurred_at"].microsecond == 123000
    assert (got["5"]["title"], got["5"]["sender"], got["5"]["body_raw"], got["5"]["has_attachment"]) == ("flat", "a@x.org", "b", False) and got["5"]["occurred_at"] == datetime(2024, 1, 2)
    assert got["6"]["labels"] == ["calendar"] and got["6"]["body_raw"] == "agenda"
    assert got["7"]["kind"] == "document" and not got["7"]["has_attachment"] and got["8"]["title"] == "T" and got["8"]["kind"] == "file"
    assert got["9"]["body_raw"] == '{"a":{"c":null,"d":1},"b":1,"name":"N"}' and got["9"]["title"] == "N"
    assert got["10"]["body_raw"] == '{"y":[1],"z":1}' and got["11"]["body_raw"] == "b" and got["12"]["kind"] == "email" and got["13"]["kind"] == "file"
    assert got["20"]["kind"] == "record" and got["20"]["body_raw"] == "{bad" and got[None]["kind"] == "email"
    assert dispatch.map_items(spark.createDataFrame([], "source string, source_id string, payload string")).count() == 0


def test_dispatch_takes_variants_and_streams(spark, tmp_path):
    schema = "source string, source_id string, payload string"
    raw = [(s, i, json.dumps(p)) for s, i, p in ITEMS]
    df = spark.createDataFrame(raw, schema)
    whole = dispatch.map_items(df)
    assert rows_of(dispatch.map_items(df.withColumn("payload", F.parse_json("payload")))) == rows_of(whole)
    assert rows_of(drain(dispatch.map_items(batches_of(spark, tmp_path, raw, schema, [1, 7])), tmp_path)) == rows_of(whole)


def test_names_in_texts(spark):
    rows = [(1, "acme and acme corp met zeta"), (2, None), (3, ""), (4, "ACME"), (5, "z" * 100_000 + "acme"), (1, "acme")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [(r["id"], r["names"]) for r in matching.with_names(df, "text", ["acme", "acme corp", "eta", "例え"]).collect()]
    assert sorted(got) == sorted([(1, ["acme", "acme corp", "eta"]), (2, []), (3, []), (4, []), (5, ["acme"]), (1, ["acme"])])
    assert [r["names"] for r in matching.with_names(df, "text", []).collect()] == [[]] * 6
    names = spark.createDataFrame([("Acme",), ("ACME",), ("abc",), (None,)], "canonical string")
    assert matching.fetched_names(names, "canonical", 4) == ["acme"] and matching.fetched_names(names, "canonical", 1, most=1) is None


@pytest.mark.parametrize("small", [0, 100_000])
def test_mentions_alike_by_automaton_and_by_blocks(spark, small):
    docs = spark.createDataFrame([(1, "We met ACME Corp."), (2, "acm"), (None, "zeta labs and acme corp"), (4, None), (5, "Zeta Labs" * 5000), (1, "We met ACME Corp.")], "doc_id long, text string")
    spine = spark.createDataFrame([("a", "Acme Corp"), ("b", "ACME CORP"), ("c", "Zeta Labs"), ("d", "met"), ("e", None)], "id string, canonical string")
    got = {(r["doc_id"], r["id"]) for r in normalize.mentions(docs, spine, small=small).collect()}
    assert {x for x in got if x[0] is not None} == {(1, "a"), (1, "b"), (5, "c")}
    assert small == 0 or {x for x in got if x[0] is None} == {(None, "a"), (None, "b"), (None, "c")}


def mail(ident, subject="Hello", sender="a@x.org", body="nothing", labels=(), **headers):
    heads = [{"name": k, "value": v} for k, v in {"Subject": subject, "From": sender, **headers}.items()]
    return ("gmail", ident, json.dumps({"id": ident, "labelIds": list(labels), "text": body, "payload": {"headers": heads}}))


MAILS = [
    mail("trusted_label", labels=["L1", "SPAM"]), mail("newsletter", **{"List-Id": "x"}), mail("automated", sender="NoReply@x.org"), mail("confidential_security", "Re: Fwd: your OTP", body="pitch deck"), mail("confidential_finance", "Payslip"),
    mail("confidential_hr", "Offer letter"), mail("subject_callnote", "Meeting notes"), mail("subject_deal", body="raising a round"), mail("known_sender", sender="Ann <Ann@Firm.com>"), mail("mention", "about Acme Corp"), mail("low_signal"), mail("low_signal", None, None, None),
]


@pytest.mark.parametrize("most", [0, 1000])
def test_every_mail_reason_is_reached(spark, tmp_path, most):
    schema = "source string, source_id string, payload string"
    senders = spark.createDataFrame([("ann@firm.com",), ("ann@firm.com",), (None,), ("",), ("+1555",)], "key string")
    names = spark.createDataFrame([("Acme Corp",), ("pit",), (None,)], "canonical string")
    rows = [*MAILS, ("whatsapp", "chat", json.dumps({"text": {"body": "a new round of funding for them"}, "from": "+1555"})), ("whatsapp", "dull", json.dumps({"text": {"body": "ok"}}))]
    rules = R.Rules(trusted_labels=("L1",))
    run = lambda df: matching.decide(dispatch.map_items(df), senders, names, rules, most=most)
    got = run(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r["reason"] == r["source_id"] for r in got if r["source"] == "gmail")
    own = {r["source_id"]: r for r in got}
    assert own["confidential_security"]["body_raw"] is None and own["confidential_hr"]["body_clean"] is None and own["subject_deal"]["body_raw"] == "raising a round"
    assert (own["mention"]["labels"], own["mention"]["signal_score"], own["newsletter"]["status"]) == (["deal-flow"], 0.95, "skipped")
    assert own["chat"]["status"] == "normalized" and own["chat"]["known"] and own["chat"]["signal_score"] == 0.85 and own["dull"]["skip_reason"] == "low_signal"
    stream = batches_of(spark, tmp_path, rows, schema, [3, 9])
    if most:
        assert rows_of(drain(run(stream), tmp_path)) == rows_of(run(spark.createDataFrame(rows, schema)))
    else:
        with pytest.raises(ValueError, match="stream"):
            run(stream)


T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("cuts", [[], [10, 11, 40]])
def test_orphans_of_streams_and_batches(spark, tmp_path, cuts):
    raw = [("chat", str(i), T0 + timedelta(minutes=i)) for i in range(60)] + [(None, "n", T0 + timedelta(minutes=60)), ("chat", None, T0 + timedelta(minutes=60)), ("chat", "end", T0 + timedelta(hours=5))]
    env = [("chat", str(i), T0 + timedelta(minutes=i, seconds=s)) for i in range(60) if (s := (30, 290, 400, None)[i % 4])] + [(None, "n", T0 + timedelta(minutes=61)), ("chat", "end", T0 + timedelta(hours=5))]
    a, b = "source string, source_id string, received_at timestamp", "source string, source_id string, ingested_at timestamp"
    out = stateful.stream_orphans(batches_of(spark, tmp_path, raw, a, cuts, "raw"), batches_of(spark, tmp_path, env, b, cuts, "env"), delay="2 hours")
    want = stateful.orphans(spark.createDataFrame(raw, a), spark.createDataFrame(env, b), "2024-01-01 03:00:00")
    got = rows_of(want)
    assert rows_of(drain(out, tmp_path)) == got and {r["source_id"] for r in want.collect()} == {None, *(str(i) for i in range(60) if i % 4 > 1)}


@pytest.mark.parametrize(("cap", "cuts"), [(0, [7, 8, 30, 55]), (1.0, []), (1.0, [7, 8, 30, 55]), (2.5, [7, 8, 30, 55])])
def test_budget_of_a_stream(spark, tmp_path, cuts, cap):
    rows = [(i, T0 + timedelta(minutes=40 * (i // 2)), Decimal(i * 7 % 5) / 10) for i in range(80)]
    rows = rows[:20][::-1] + rows[20:] if not cuts else rows  # within a batch in any order
    schema = "id long, at timestamp, usd decimal(12,6)"
    want = gold.budget_admit(spark.createDataFrame(rows, schema), cap)
    got = drain(stateful.stream_budget(batches_of(spark, tmp_path, rows, schema, cuts), cap), tmp_path)
    assert sorted((r["id"], float(r["running"])) for r in got.collect()) == sorted((r["id"], float(r["running"])) for r in want.collect())
    assert cap == 0 or 0 < got.count() < 80


@pytest.mark.parametrize("cuts", [[], [1, 2, 5, 9]])
def test_retries(spark, tmp_path, cuts):
    good, bad = '{"a": 1}', "{oops"
    rows = [("twice", 1, bad), ("dead", 1, bad), ("once", 1, good), ("twice", 2, "[1]"), ("dead", 2, None), ("twice", 3, good), ("dead", 3, bad), ("dead", 4, good), ("open", 1, bad), ("twice", 4, bad), (None, 1, good), ("once", 2, good)]
    schema = "key string, seq int, payload string"
    want = {("twice", "good", 3), ("dead", "dead", 3), ("once", "good", 1)}
    pick = lambda df: {(r["key"], r["outcome"], r["attempts"]) for r in df.collect()}
    batch = stateful.retry_outcomes(spark.createDataFrame(rows, schema), 3)
    stream = drain(stateful.stream_retries(batches_of(spark, tmp_path, rows, schema, cuts), 3), tmp_path)
    assert pick(batch) == pick(stream) == want and batch.count() == stream.count() == 3
    assert rows_of(batch) == rows_of(stream)


def test_counts_kept_live(spark, tmp_path):
    rows = [(["raw", "done", None][i % 3] if i < 20 else "raw", T0 + timedelta(minutes=i)) for i in range(30)]
    schema = "status string, at timestamp"
    stateful.keep_counts(batches_of(spark, tmp_path, rows, schema, [4, 20]), f"{tmp_path}/root", f"{tmp_path}/log").awaitTermination()
    want = rows_of(stateful.status_counts(spark.createDataFrame(rows, schema)))
    assert rows_of(publish.published(spark, f"{tmp_path}/root")) == want and publish.versions(spark, f"{tmp_path}/root") == [1, 2, 3]
    assert {r["status"]: r["n"] for r in stateful.counts_in_state(spark, f"{tmp_path}/log").collect()} == {"raw": 17, "done": 7, None: 6}


def test_readers_see_whole_versions_while_others_publish(spark, tmp_path):
    root, failed, seen, stop = str(tmp_path), [], [], threading.Event()
    publish.publish(spark.range(10).withColumn("v", F.lit(-1)), root)

    def read():
        while not stop.is_set():
            try:
                got = {(r["v"], r["n"]) for r in publish.published(spark, root).groupBy("v").agg(F.count("*").alias("n")).collect()}
                seen.append(got)
            except Exception as e:
                failed.append(e)

    def write(k):
        for i in range(10):
            publish.publish(spark.range(10).withColumn("v", F.lit(k * 10 + i)), root, keep=100)

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert not failed and len(seen) > 3 and all(len(s) == 1 and next(iter(s))[1] == 10 for s in seen)
    assert publish.versions(spark, root) == list(range(1, 22))


def test_old_versions_go_and_a_missing_one_is_an_error(spark, tmp_path):
    for i in range(4):
        publish.publish(spark.range(i), str(tmp_path), keep=2, grace=0)
    assert publish.versions(spark, str(tmp_path)) == [3, 4] and publish.published(spark, str(tmp_path)).count() == 3 and publish.published(spark, str(tmp_path), 3).count() == 2
    assert len(list((tmp_path / "data").iterdir())) == 2
    for n in (1, None):
        with pytest.raises(ValueError, match="version|published"):
            publish.published(spark, str(tmp_path) if n else f"{tmp_path}/none", n)


def test_landing_creates_its_target(spark, tmp_path):
    rows = spark.createDataFrame([("chat", "1", 2, "b"), ("chat", "1", 1, "a"), (None, "1", 1, "c")], "source string, source_id string, seq int, body string")
    land = streams.foreach_land(f"{tmp_path}/new", rows.schema, "seq")
    for _ in range(2):
        land(rows, 0)
    assert {(r["source"], r["body"]) for r in spark.read.parquet(f"{tmp_path}/new").collect()} == {("chat", "a"), (None, "c")}
