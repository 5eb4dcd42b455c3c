"""Intros, company groups, survivors and the kept-distinct report against brute force on small odd inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from dealspark.operators import dedup, graph


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("most", [None, 1, 4, 1000])
def test_intro_paths(spark, most):
    r = random.Random(2)
    works = list({(f"p{r.randrange(14)}", f"f{r.randrange(7)}") for _ in range(40)}) + [("p1", "f1"), ("p1", "f1"), (None, "f2"), ("p3", None)]
    names = {f"p{i}": f"n{i % 9}" for i in range(13)}  # p13 has no name; some share one
    nodes = {f"f{i}": f"Firm {i % 3}" for i in range(6)}  # f6 is no bridge
    target, home = {"f1", "f3"}, {"f0"}
    staff = {p for p, f in works if f in target and p}
    own = {p for p, f in works if f in home}
    want = {(c, names[c], nodes[f], b, names[b], c in own) for (b, f), (c, g) in itertools.product(set(works), set(works)) if f == g and f in nodes and f not in target and b in staff and c not in staff and b in names and c in names}
    df = frame(spark, works, "src string, dst string")
    ids = lambda xs: frame(spark, [(x,) for x in sorted(xs)] * 2, "id string")
    got = graph.intro_paths(df, df, frame(spark, list(names.items()), "id string, canonical string"), frame(spark, list(nodes.items()), "id string, canonical string"), ids(target), ids(home), most)
    order = lambda x: (not x[5], x[1], x[0], x[2], x[3])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)[:most] and len(want) > 20


def test_company_groups_close_over_keys(spark):
    companies = [("a", "Acme", None), ("b", "ACME ", "https://www.x.com/"), ("c", "Other", "http://x.com"), ("d", "Third", None), ("e", "Fourth", ""), ("f", None, None), ("g", "Alone", None), ("h", "Fifth", "  ")]
    aliases = [("d", "other"), ("e", "nobody"), ("g", "nobody"), ("h", None), ("h", "")]
    got = graph.company_groups(frame(spark, companies, "id string, canonical string, website string"), frame(spark, aliases, "id string, alias string"))
    assert {r["id"]: r["cluster"] for r in got.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f", "g": "g", "h": "h"}
    works = frame(spark, [("p", "a", False, "2001", "2002"), ("p", "c", None, "2003", None), ("q", "d", False, None, None), ("p", "zz", True, None, None)], "src string, dst string, current boolean, start string, stop string")
    people = graph.group_people(works, frame(spark, [("p", "P"), ("q", "Q")], "id string, canonical string"), got)
    assert {(r["cluster"], r["id"], r["current"], r["tenure"]) for r in people.collect()} == {("a", "p", True, "2003"), ("a", "q", False, None)}


def test_survivor_policies(spark):
    clusters = frame(spark, [("a", 1), ("b", 1), ("c", 1), ("x", 2)], "id string, cluster int")
    names = frame(spark, [("a", "Abe Lincoln Jr"), ("b", "Abe"), ("c", "Abe Lincoln"), ("x", None)], "id string, canonical string")
    degree, profiles = frame(spark, [("b", 5), ("c", 5)], "id string, degree long"), frame(spark, [("c",), ("c",)], "id string")
    pick = lambda policy, p=None: {r["id"]: r["keeper"] for r in dedup.pick_survivor(clusters, degree, names, policy, p).collect()}["a"]
    assert [pick("company", profiles), pick("company"), pick("person", profiles), pick("person"), pick("core"), pick("degree")] == ["c", "b", "c", "a", "b", "b"]


def test_kept_distinct_against_all_pairs(spark):
    r = random.Random(4)
    some = lambda *x: r.choice([None, None, *x])
    rows = [(f"i{i:02d}", r.choice(["asha", "Asha Rao", "asha rao sen", "Bo", " ", None, "Asha-Rao"]), some("s1", "s2"), some("e1", "e2"), some("1", "2"), r.sample(["c1", "c2"], r.randrange(3)), r.sample(["t1", None], r.randrange(2)), r.randrange(2)) for i in range(40)]
    rows += [("j1", "Zed Q", None, None, None, None, None, None), ("j2", "zed q", None, None, None, [], [None], 0), ("j3", "zed q", None, None, None, [], [], 0)]
    schema = "id string, name string, slug string, email string, phone string, companies array<string>, threads array<string>, degree long"

    def sign(x):
        toks = tuple("".join(c if c.islower() and c.isascii() else " " for c in (x[1] or "").lower()).split())
        return toks, x[2], x[3], x[4], frozenset(c for c in x[5] or () if c), frozenset(t for t in x[6] or () if t), not x[7]

    def why(a, b):
        (ta, sa, ea, pa, ca, ha, da), (tb, sb, eb, pb, cb, hb, _) = a, b
        for n, x, y in (("slug", sa, sb), ("email", ea, eb), ("phone", pa, pb)):
            if x and y and x != y:
                return f"different {n}"
        if (sa and sa == sb) or (ea and ea == eb) or (pa and pa == pb):
            return None
        co, thr = bool(ca & cb), bool(ha & hb)
        if ta != tb:
            return None if not sa and not ea and co and (thr or da) else "unverified (name only)"
        return None if (co or thr if len(ta) > 1 else co and thr) else "same name but no shared company or thread"

    signs, first = {x[0]: sign(x) for x in rows}, {}
    for i in sorted(signs):
        first.setdefault(signs[i], i)
    want: dict = {}
    for i, j in itertools.combinations(sorted(signs), 2):
        a, b = sorted((signs[i], signs[j]), key=lambda s: len(s[0]))
        if a[0] and a[0] == b[0][: len(a[0])] and (reason := why(a, b)):
            key = (*sorted((first[a], first[b])), reason)
            want[key] = want.get(key, 0) + 1
    df = frame(spark, rows, schema)
    got = {(x["a"], x["b"], x["reason"]): x["pairs"] for x in dedup.kept_distinct(df).collect()}
    assert got == want and any(a == b for a, b, _ in got)
    assert {x["id"]: x["class"] for x in dedup.person_classes(df).collect()} == {i: first[s] for i, s in signs.items()}
    assert dedup.kept_distinct(df.where("false")).count() == 0


def test_a_hot_core_is_split(spark):
    """The joins that meet a hot key have their aggregate written, so its partition is split."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 30_000, 1, 12)
        hot = lambda n: F.when(F.col("id") % 3 == 0, F.lit("hothot")).otherwise(F.concat(F.lit(n), F.floor(F.col("id") / 2)))
        outs = [
            dedup.core_clusters(rows.select(F.col("id"), F.lit("x").alias("type"), hot("core").alias("canonical"))), dedup.web_clusters(rows.select("id", hot("http://w").alias("website"))),
            dedup.inherit_notes(rows.select("id", hot("h").alias("content_hash"))), dedup.pick_survivor(rows.select("id", hot("k").alias("cluster")), rows.select("id", F.lit(1).alias("degree")), rows.select("id", F.lit("n").alias("canonical"))),
        ]
        for out in outs:
            assert len(out.collect()) >= 10_000
            assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
