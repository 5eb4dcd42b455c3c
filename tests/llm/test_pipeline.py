"""Each stage of the pipeline against a plain version over its own input: which rows stay, and their texts."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import brute_components

import corpus_pipeline
from dealspark.llm import pii, simhash, toxicity
from dealspark.llm.common import stored

R = random.Random(11)
VOCAB = ["".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randint(1, 3))) for _ in range(900)]


def say(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


BENCH = [say(40), say(15)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    texts = [f"{say(80)}. {say(20)}" for _ in range(260)]
    for i in range(0, 120, 2):
        texts[i] += ". " + " ".join(x for _ in range(3) for x in (R.choice(["worthless", "disgusting"]), say(5)))
    for i in range(130, 150):
        texts[i] = texts[129] if i % 2 else texts[129] + " " + say(1)
    texts[151] = say(50) + " " + BENCH[0] + " " + say(50)
    texts[153] = BENCH[1] + " " + say(2)
    texts[155] += " write to jo.do@mail.example.com or +1 (212) 555-0188"
    texts[157] += " dis-gusting dis-gusting worthlesss"
    alone = say(60)
    rows = [(i, t, "en", f"s{i % 3}", len(t), i) for i, t in enumerate(texts)] + [(900, None, None, None, None, 1), (901, "", "en", None, 0, 1), (None, alone, None, "s1", len(alone), 1)]
    rows += [rows[200], rows[200]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `x.y` int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 120 and i % 2 == 0)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_stages_by_content(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages, key = dict(corpus_pipeline.STAGES), lambda r: tuple(map(str, r))

    rows, out = docs.collect(), stored(stages["toxicity"](spark, docs, tables), "t")
    assert out.columns == docs.columns
    toxic = {i for i in range(0, 120, 2)} | {157}
    assert sorted(map(key, out.collect())) == sorted(key(r) for r in rows if r["doc_id"] not in toxic)

    rows, out = out.collect(), stored(stages["near_duplicates"](spark, out, tables), "n")
    fps = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    rank = [order.index(i) for i in range(len(rows))]
    keep = {order[c] for c in brute_components(fps, rank)}
    assert sorted(map(key, out.collect())) == sorted(key(rows[i]) for i in keep)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(200) == 1 and not {131, 140, 149} & set(ids) and (900 in ids) != (901 in ids)

    rows, out = out.collect(), stored(stages["decontamination"](spark, out, tables), "d")
    windows = {tuple(w[i : i + 10]) for w in map(words, BENCH) for i in range(len(w) - 9)}
    got = {r["doc_id"]: r for r in out.collect()}
    for r in rows:
        w = words(r["text"])
        hit = {p for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows for p in range(i, i + 10)}
        if hit and len(hit) >= 0.5 * len(w):
            assert r["doc_id"] not in got
        else:
            left = got[r["doc_id"]]
            assert words(left["text"]) == [x for i, x in enumerate(w) if i not in hit] and (hit or left == r)
            assert not hit or left["n_chars"] == len(left["text"])
    assert 153 not in got and 151 in got

    rows, out = out.collect(), stored(stages["personal_data"](spark, out, tables), "p")
    model = pii.train(spark.createDataFrame(rows, out.schema))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = None if r["text"] is None else pii.redacted(r["text"], pii.find_spans(r["text"], model)[1])
        assert got[r["doc_id"]]["text"] == want and got[r["doc_id"]]["x.y"] == r["x.y"]
    assert got[155]["text"].endswith("write to <email> or <phone>")

    rows, out = out.collect(), stages["mixing"](spark, out, tables)
    size, taken = {}, {}
    n = lambda r: len((r["text"] or "").split())
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + n(r)
    for r in out.collect():
        assert 1 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * n(r)
    free, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}, 1.5 * sum(size.values()), {}
    while over := {s for s in free if left * free[s] / sum(free.values()) > 2 * size[s]}:
        want |= {s: 2 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), {s: w for s, w in free.items() if s not in over}
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    for s in size:
        assert abs(taken.get(s, 0) - want[s]) <= 120

    whole = sorted((str(r["doc_id"]), r["text"] or "", r["copies"]) for r in corpus_pipeline.run(spark, tables).collect())
    assert whole == sorted((str(r["doc_id"]), r["text"] or "", r["copies"]) for r in out.collect())


def test_stages_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")) is None
