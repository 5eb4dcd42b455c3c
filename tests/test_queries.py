"""Every registered query with SQL against DuckDB, on the smallest tables; scalar rules against their golden values."""

import duckdb
import pytest

from dealspark.functions import scalars as S
from dealspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    one = lambda v: None if v is None else round(float(v), 4) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else int(v)
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_safe_num(spark):
    want = {"40-60": 40.0, "$5M": 42.5, "$1.1B": 9350.0, "~40": 40.0, "₹50 Cr": 50.0, "": None, "n/a": None, "12": 12.0, "12.5": 12.5, None: None, "40 M": 340.0, "1,200": 1200.0}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", S.safe_num("x").alias("y")).collect()} == want


def test_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x" * 300,), ("A/B : C*?",)], "x string").select(S.safe_name("x").alias("y"))
    long, odd = [r["y"] for r in df.collect()]
    assert len(long) <= 120 and not set('/:*?') & set(odd)
    people = {"Asha Rao": True, "CEO-Founder": False, "Al": False, "A1 B": False, "J. O'Neil": True, None: False}
    df = spark.createDataFrame([(k,) for k in people], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", S.is_person_name("x").alias("y")).collect()} == people
    one = spark.range(1).select(S.make_aliases(F.lit("Blue River Capital Partners")).alias("a"), S.parse_contacts(F.lit('"Rao, A" <A@x.org>, b@y.org')).alias("c"), S.norm_co(F.lit("The Blue-River Technologies Pvt. Ltd.")).alias("n"), S.fy_period(F.lit("2024-03-31")).alias("f")).first()
    assert one["a"] == ["Blue River", "BR"] and [(c["name"], c["email"]) for c in one["c"]] == [("Rao, A", "a@x.org"), ("", "b@y.org")] and one["n"] == "blue river" and one["f"] == "FY24"


def test_chunks(spark):
    from dealspark.operators import text

    long = spark.createDataFrame([(1, "x" * 5400), (2, "a\n\nb\n\n" + "y" * 1799), (3, ""), (4, None)], "id int, text string")
    got = text.chunk(long).collect()
    assert [len(r["chunk"]) for r in got if r["id"] == 1] == [1800] * 3 and all(len(r["chunk"]) <= 1800 for r in got)
    assert [r["chunk"] for r in got if r["id"] == 2] == ["a\n\nb", "y" * 1799] and not [r for r in got if r["id"] > 2]


def test_salvage_json(spark):
    rows = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so: {"a": 3} end', "broken {", None]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    got = [r["y"] for r in df.select(S.salvage_json("x", "a int, confidence string").alias("y")).collect()]
    assert [g["a"] for g in got] == [1, 2, 3, None, None] and got[3]["confidence"] == "low"


def test_streaming_equals_batch(spark, tmp_path):
    from dealspark.plans.derived import Tables
    from dealspark.streaming import streams

    raw = Tables(spark, SF).raw_item().select("source", "source_id", "body")
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    streams.run_available(streams.stream_normalize(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    cols = ["source", "source_id", "content_hash", "status"]
    assert plain(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect())) == plain(map(tuple, streams.stream_normalize(raw).select(*cols).collect()))


def test_land_twice_is_once(spark):
    from dealspark.sources import raw

    rows = spark.createDataFrame([("m", "1", "a", 1), ("m", "1", "b", 2), ("m", "2", "c", 3)], "source string, source_id string, body string, seq int")
    first = raw.land_raw(rows)
    assert sorted(r["body"] for r in first.collect()) == ["a", "c"] and raw.land_raw(rows, first).count() == 0
