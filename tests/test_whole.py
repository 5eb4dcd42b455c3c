"""What operators do beyond the sizes of the smallest tables."""

from pyspark.sql import functions as F

from dealspark.operators import gold, search, views


def test_knn_takes_queries_as_rows_in_blocks(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(300)] + [(300, None), (301, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 100 = 0 AND vec_id < 300").selectExpr("vec_id AS query_id", "embedding AS q")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for block in (1, 2048):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in search.knn(v, q, 4, block).collect())
        want = []
        for i in (0, 100, 200):
            a = rows[i][1]
            near = sorted((round(1 - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 3) + 0.0, j) for j, b in rows[:300])[:4]
            want += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
        assert got == want


def test_knn_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, []), (5, [1.0, None]), (None, [1.0, 0.0]), (6, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, [5.0, 0.0, 0.0]), (12, []), (13, None), (10, [2.0, 0.0])], "query_id long, q array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in search.knn(v, q, 4, 1).collect()]
    assert sorted(x for x in got if x[0] == 11) == [(11, 1, 3, 0.0), (11, 2, 1, None), (11, 3, 2, None), (11, 4, 2, None)]
    assert sorted(x for x in got if x[0] == 10) == [(10, 1, 1, 0.0), (10, 2, 1, 0.0), (10, 3, 2, 1.0), (10, 4, 2, 1.0)]  # a repeated query is one
    assert {x[3] for x in got if x[0] == 12} == {None} and not [x for x in got if x[0] == 13]
    assert search.knn(v.limit(0), q, 4).count() == 0 and search.knn(v, q.limit(0), 4).count() == 0


def test_every_pair_of_blocks_meets_once(spark):
    for rows, queries, tasks in ((1, 1, 32), (50, 1, 32), (1000, 10, 64), (3, 900, 16)):
        a, b = search.grid(rows, queries, tasks)
        assert 1 <= a <= rows and 1 <= b <= queries and a * b <= 2 * tasks


def test_hits_with_their_origin(spark):
    hits = spark.createDataFrame([(1, 7, 0.1, 1), (1, 8, 0.2, 2), (1, 9, 0.3, 3)], "query_id long, vec_id long, distance double, rank int")
    chunks = spark.createDataFrame([(7, 70, 3, "t", "a.pdf"), (8, 80, None, None, None), (9, 90, 1, "x", None)], "vec_id long, envelope_id long, page int, text string, attachment_ref string")
    envelopes = spark.createDataFrame([(70, "Acme", None, "pdf", "indexed", "r"), (80, "", "Call\nwith " + "x" * 80, "gmail", "indexed", "mail"), (90, "B", "t", "pdf", "skipped", "r")], "envelope_id long, company string, title string, source string, status string, ref string")
    got = {r["vec_id"]: r for r in search.retrieved(hits, chunks, envelopes).collect()}
    assert set(got) == {7, 8} and (got[7]["cite"], got[7]["kind"], got[7]["ref"]) == ("Acme — Deck p.3", "deck", "a.pdf")
    title = "Call\nwith " + "x" * 80
    assert (got[8]["cite"], got[8]["kind"], got[8]["ref"]) == (title + " — " + title.replace("\n", " ")[:50], "email", "mail")


def test_lists_of_a_hot_key_are_whole(spark):
    df = spark.range(25).select(F.lit("k").alias("key"), F.array(F.format_string("i%02d", "id")).alias("items"), "id", (-F.col("id")).alias("at"))
    got = gold.merge_lists(df, "key", "items", "at", "id", 10).orderBy("block").collect()
    assert [x for r in got for x in r["items"]] == [f"i{i:02d}" for i in range(24, -1, -1)] and [len(r["items"]) for r in got] == [10, 10, 5]
    rows = df.select(F.col("key").alias("referrer"), F.col("items")[0].alias("company"))
    got = views.referrers(rows.unionByName(rows), 10).orderBy("block").collect()
    assert [x for r in got for x in r["companies"]] == [f"i{i:02d}" for i in range(25)] and {r["n"] for r in got} == {25}
