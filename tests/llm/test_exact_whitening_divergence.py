"""Exact dedup, embedding whitening and the divergence audit against brute force, on nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealspark.llm import divergence, exact_dedup, whitening

SCHEMA = "doc_id long, text string, lang string, source string, h int, sha int, row int, last int, doc int, bytes int, c0 int"
LONG = "lorem ipsum " * 40_000


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)


ROWS = [(i, t, None, None) for i, t in enumerate(["a", "b", "a", None, "", LONG, LONG, "A", "a ", "é", "c"])] + [(2, "a", "x", None), (None, "b", None, None), (None, "n", None, None), (None, "n", None, None), (None, None, None, None)]


@pytest.mark.parametrize(("keep", "most", "digits"), [("smallest", 0, 1), ("largest", 200_000, 1), ("largest", 0, 32), ("smallest", 200_000, 32)])
def test_exact_groups(spark, monkeypatch, keep, most, digits):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_GROUPS", most)  # 0: by merge joins
    weak = lambda body: F.unhex(F.concat(F.lit("0"), F.substring(F.md5(body.cast("binary")), 1, digits)))  # noqa: E731  one digit: many collisions
    docs = docs_of(spark, ROWS)
    by = defaultdict(list)
    for i, t, *_ in ROWS:
        by[t or ""].append(i)
    pick = min if keep == "smallest" else max
    want = {t: (pick((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}
    got = exact_dedup.exact_groups(docs, keep, digest=weak).collect()
    assert len(got) == len(ROWS) and got[0].asDict().keys() == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    assert Counter((r["doc_id"], sha[r["text_sha256"]]) for r in got) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert all((r["keep_id"], r["group_size"]) == want[sha[r["text_sha256"]]] for r in got)
    kept = Counter(sha[r["text_sha256"]] for r in got if r["kept"])
    assert kept == Counter(by.keys()) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    whole = exact_dedup.keep_one(docs, keep, digest=weak)
    assert whole.columns == docs.columns and Counter((r["doc_id"], r["text"] or "") for r in whole.collect()) == Counter((want[t][0], t) for t in by)
    assert all(r["c0"] == 7 for r in whole.collect())


def test_exact_groups_normalised_and_empty(spark):
    docs = docs_of(spark, [(1, " A", None, None), (2, "a", None, None), (3, None, None, None)])
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs, normal=lambda t: F.lower(F.trim(t))).collect()}
    assert got[2] == (1, False, hashlib.sha256(b"a").hexdigest()) and got[1][1] and got[3][0] == 3
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0 and exact_dedup.keep_one(docs.where("false")).columns == docs.columns


def test_exact_groups_text_ids(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "doc_id string, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, "largest").collect()} == {"b": "b", "a": "b", "c": "c"}


def test_bytes_decide(spark):
    """Texts that share both digests are not taken as copies in silence."""
    docs = docs_of(spark, [(1, "x", None, None), (2, "y", None, None)])
    real = F.sha2
    try:
        F.sha2 = lambda c, n: F.when(F.lit(True), F.lit("00"))
        with pytest.raises(ValueError, match="other bytes"):
            exact_dedup.exact_groups(docs, digest=lambda b: F.unhex(F.lit("00")))
    finally:
        F.sha2 = real


def test_hot_group_is_split(spark, monkeypatch):
    """Beyond the broadcast bound a hot group's partition is split in the final plan."""
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_GROUPS", 0)
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "40k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.range(0, 12_000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 6_000)).alias("text"))
        out = exact_dedup.exact_groups(docs)
        assert out.where("kept").count() < 12_000
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def brute_whitening(rows, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r] for r in rows], dtype=object)
    n, s = len(x), x.sum(0)
    z = n * x - s
    v = (z.T @ z).astype(np.longdouble) / np.longdouble(n) ** 3
    return n, (z * z).sum(1), v, z.astype(np.longdouble) / n


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 12)) * np.linspace(3, 0.3, 12)
    base[:, 5] = base[:, 4] + r.normal(size=400) * 0.05
    vectors = [[float(np.float32(c)) for c in row] for row in base]
    odd = [None, [], [None] * 12, [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11], [1.0] * 5]
    rows = [(i, v, 9) for i, v in enumerate(vectors)] + [(3, vectors[3], 9), (None, vectors[7], 9)] + [(900 + i, v, 9) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened int").repartition(5)
    got = whitening.whitened_components(df, "embedding", "vec_id", 8).collect()
    fit = [*vectors, vectors[3], vectors[7]]
    n, deviation, v, centred = brute_whitening(fit, 8)
    assert len(got) == 8 * len(fit) and {x["n"] for x in got} == {n} and got[0]["identity_error"] < 1e-9
    assert {x["component"] for x in got} == set(range(1, 9)) and not any((x["vec_id"] or 0) >= 900 for x in got)
    values, axes = np.linalg.eigh(v.astype(np.float64))
    values, axes = values[::-1], axes[:, ::-1]
    want = centred.astype(np.float64) @ axes[:, :8] / np.sqrt(values[:8])
    mine = {(x["vec_id"], x["component"]): x for x in got}
    for c in range(8):
        sign = np.sign(mine[10, c + 1]["whitened"] * want[10, c])
        assert all(abs(mine[i, c + 1]["whitened"] - sign * want[i, c]) < 1e-9 for i in range(400))
        assert abs(mine[0, c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-10
    assert all(mine[i, 1]["deviation"] == deviation[i] for i in range(400)) and mine[None, 1]["deviation"] == deviation[7]
    whole, _ = whitening.whiten(df.withColumnRenamed("whitened", "extra"), "embedding", 2)
    assert whole.columns == ["vec_id", "extra", "whitened", "deviation"] and whole.where("size(whitened) = 2").count() == n


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whitened_components(spark.createDataFrame([(1, [0.5, 2.0])], schema), "embedding", "vec_id").collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, None, None, 0, None), (2, None, None, 0, None)]
    line = whitening.whitened_components(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(5)], schema), "embedding", "vec_id").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and all(r["identity_error"] < 1e-12 for r in line)
    assert whitening.whitened_components(spark.createDataFrame([], schema), "embedding", "vec_id").count() == 0
    huge = whitening.whitened_components(spark.createDataFrame([(1, [1e17, 1.0]), (2, [-1e300, 2.0])], schema), "embedding", "vec_id").collect()
    assert {r["deviation"] for r in huge} == {None} and len(huge) == 4


def exact_gram(x):
    return (x.astype(object).T @ x.astype(object)).tolist()


@pytest.mark.parametrize("size", [100, 1 << 30, 1 << 50])
def test_exact_sums(size):
    x = np.random.default_rng(1).integers(-size, size, (200, 5))
    assert whitening._gram(x).tolist() == exact_gram(x) and whitening._sum(x).tolist() == x.astype(object).sum(0).tolist()


@pytest.mark.parametrize("precise", [128, 0])
@pytest.mark.parametrize("gaps", [[1, 2, 3, 4, 5, 6], [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-11, 5], [1e-6, 1e-3, 1, 1, 1, 10], [0, 0, 0, 1, 1 + 1e-13, 1e4], [0] * 6, [2] * 6])
def test_eigen(monkeypatch, gaps, precise):
    """Known eigenvalues, also clustered and equal ones, turned by a known rotation."""
    monkeypatch.setattr(whitening, "PRECISE", precise)
    places = 200
    fix = lambda m: np.array([[int(np.ldexp(np.longdouble(x), 63)) << (places - 63) for x in r] for r in m], dtype=object)
    q, one = fix(np.linalg.qr(np.random.default_rng(2).normal(size=(6, 6)))[0]), np.diag([1 << places] * 6)
    for _ in range(5):  # orthonormal to all places
        q = q + ((q @ ((one - ((q.T @ q) >> places)) // 2)) >> places)
    want = sorted(gaps, reverse=True)
    v = (((q * np.array([int(g * 2**60) for g in want], dtype=object)) >> 60) @ q.T) >> places
    v = (v + v.T) // 2
    values, x = whitening.eigen(v)
    values, x, axes = values / np.longdouble(2) ** places, x.astype(np.longdouble), (q >> (places - 62)).astype(np.longdouble) / 2**62
    top = max(want[0], 1e-30)
    assert np.abs(values - np.array(want)).max() < 1e-16 * top and np.abs(x.T @ x - np.eye(6)).max() < 1e-17
    real = (v >> (places - 62)).astype(np.longdouble) / 2**62
    assert np.abs(real @ x - x * values).max() < 1e-16 * top
    for i in range(6):  # a direction is fixed where its eigenvalue stands apart
        gap = np.abs(np.delete(want, i) - want[i]).min() / top
        if gap > (1e-13 if precise else 1e-7):
            assert np.abs(x[:, i] * np.sign(x[:, i] @ axes[:, i]) - axes[:, i]).max() < (1e-16 if precise else 1e-17 / gap)


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t in df if df[t] >= least}
        count = defaultdict(Counter)
        for _, s, terms in own:
            count[s].update(t for t in terms if t in kept)
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept))
        for s in count:
            pairs = [(o, sum(abs(share(count[s], t) - share(count[o], t)) for t in kept)) for o in count if o != s]
            every = sum(count.values(), Counter())
            terms = [(t, share(count[s], t) - share(every, t)) for t in kept if count[s][t] and share(count[s], t) > share(every, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))) if k < most]
    return sorted(out)


@pytest.mark.parametrize(("rows_a_leaf", "terms_a_leaf", "most", "fan"), [(32, 512, 100_000, 4), (2, 3, 0, 2)])
def test_audit(spark, monkeypatch, rows_a_leaf, terms_a_leaf, most, fan):
    for k, v in {"LEAF_ROWS": rows_a_leaf, "LEAF_TERMS": terms_a_leaf, "MAX_BROADCAST": most, "K": fan, "MOST_TERMS": 40}.items():
        monkeypatch.setattr(divergence, k, v)
    r = random.Random(5)
    words = ["Alpha", "beta", "été", "ÉTÉ", "例え", "x1y", "don't", "zz", *(f"w{c}" for c in "abcdefghijklm")]
    rows = [(" ".join(r.choices(words[: 5 + i % 17], k=r.randrange(12))), ["en", "fr", None][i % 3], f"s{i % 11}" if i % 5 else "hot") for i in range(240)]
    rows += [(None, "en", "silent"), ("", "de", "a"), ("", "de", "b"), ("lone words", "xx", None), ("beta " * 9000, "en", "hot"), rows[0], rows[0], ("only once", "en", "s1")]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4, 5) for x in rows], "text string, lang string, source string, row int, col int, p int, a int, term int").repartition(3)
    got = divergence.audit(df, 3, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 3, 4)


def test_audit_tree_prices_empty_quadrants(spark, monkeypatch):
    """Sources that share no term: most of the tree is priced unseen, and widths add up to all terms."""
    for k, v in {"LEAF_ROWS": 1, "LEAF_TERMS": 2, "K": 2}.items():
        monkeypatch.setattr(divergence, k, v)
    rows = [(f"{chr(97 + s)}{chr(97 + t)}", "en", f"s{s}") for s, t in itertools.product(range(6), range(8))]
    langs, groups, cells = divergence.matrix(spark.createDataFrame(rows, "text string, lang string, source string"), 1)
    leaves = cells.groupBy("lang", F.col("row").alias("a"), F.floor(F.col("col") / 2).alias("c")).agg(F.count("*").alias("n"))
    live, priced = divergence.walk(langs, leaves)
    width = Counter()
    for r in [*live.collect(), *priced.collect()]:
        width[r["a"], r["b"]] += r["width"]
    assert width == {(a, b): 48 for a in range(6) for b in range(a, 6)}
    assert live.agg(F.sum("width")).first()[0] == 6 * 8 + 15 * 16


def test_audit_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    one = divergence.audit(spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string"))
    assert one.count() == 0
