"""Windows of texts pass a filter of the names' keys before they are shuffled."""

import random

from pyspark.sql import functions as F

from dealspark.operators import normalize, windows


def test_only_windows_that_may_be_keys_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 50)  # texts are cut into pieces, several to a text and several texts to a piece
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abc é😀İ") for _ in range(n))
    names = [(f"k{i}", word(r.choice([3, 4, 5, 7, 8, 9, 15, 16, 17, 40]))) for i in range(300)] + [("k1", "abcd"), ("x", None), ("y", "")]
    texts = [(i, word(r.randrange(300)) + r.choice(names[:300])[1] + word(r.randrange(60))) for i in range(120)] + [(200, None), (201, ""), (202, "ABCD"), (202, "abcd" * 100)]
    docs, spine = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(names, "id string, canonical string")
    low = lambda df, c: [(x[0], x[1]) for x in df.select(df.columns[0], F.lower(c)).collect() if x[1]]
    kept = [(i, x) for (i, raw), x in zip([n for n in names if n[1]], [y for _, y in low(spine, "canonical")]) if len(raw) >= 4]
    want = {(d, i) for d, t in low(docs, "text") for i, x in kept if x in t}
    got = [(x["doc_id"], x["id"]) for x in normalize.mentions(docs, spine, small=0).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert normalize.mentions(docs, spine.where("false"), small=0).count() == 0 and normalize.mentions(docs.where("false"), spine, small=0).count() == 0
    keys = spark.range(20_000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("key"))
    rows = spark.range(2000).select("id", F.concat(F.lit("Met with Customer#"), F.lpad((F.col("id") * 7).cast("string"), 9, "0"), F.lit(" about 1-URGENT")).alias("text"))
    passed = windows.key_windows(rows, "id", "text", windows.key_filter(keys))
    assert passed.join(keys.hint("merge"), "key").count() == 2000 and passed.count() < 4000  # of 2000 * 25 windows
