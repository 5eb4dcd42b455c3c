"""What kept queries from finishing on large tables: streams beyond a bound, and work in few or hot tasks."""

from pyspark.sql import functions as F

from dealspark.operators import dedup, dispatch, graph, matching
from dealspark.plans import registry

SF = "/root/testdata/sf0.001"


def test_mapping_is_spread_over_tasks(spark):
    raw = spark.range(0, 400, 1, 1).select(F.lit("gmail").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit('{"text":"x"}').alias("payload"))
    assert dispatch.map_items(raw).select(F.spark_partition_id()).distinct().count() > 1


def test_a_stream_beyond_the_bound_of_names(spark, monkeypatch):
    monkeypatch.setattr(matching, "fetched_names", lambda *a: None)
    rows = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
    got = rows("stream_decisions")
    assert got == rows("mail_decisions") and {"mention", "low_signal"} & {x[1] for x in got}


def test_a_hot_company_is_dealt_over_tasks(spark):
    """Every end of a hot company goes by its neighbour; neighbours that are no entity count, as in SQL."""
    e = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("p"), F.col("id") % 1500).alias("src"), F.lit("works_at").alias("rel"), F.lit("g").alias("dst"))
    v = spark.createDataFrame([("g", "company"), ("g", "company")], "id string, type string").withColumn("canonical", F.lit("G"))
    out = graph.company_360(v, e)
    assert [tuple(x) for x in out.collect()] == [("g", "works_at", "in", 2000, 1500)]
    assert "hashpartitioning(id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


def test_coinvestors_deal_their_pairs(spark):
    """Tasks grow with the pairs, not with the rows that make them."""
    p = spark.range(0, 1200, 1, 1).select(F.concat(F.lit("s"), F.col("id") % 40).alias("src"), F.concat(F.lit("c"), F.floor(F.col("id") / 40)).alias("dst"))
    out = graph.coinvestors(p, 500)
    assert {x["shared"] for x in out.collect()} == {30} and out.count() == 780
    assert graph.coinvestors(p, 500).select(F.spark_partition_id()).distinct().count() > 4
    assert graph.coinvestors(p.where("false")).count() == 0


def test_companies_are_spread_and_their_names_parsed_once(spark):
    from dealspark.operators import profiles
    from dealspark.plans.derived import Tables
    from dealspark.plans.profiles import nested_companies

    assert nested_companies(Tables(spark, SF)).select(F.spark_partition_id()).distinct().count() > 1
    names = ['{"firstName":"A","middleName":"","lastName":"B","name":"C"}', '{"name":"C"}', '{"name":""}', "{}", "{bad", "Plain", "", None]
    df = spark.createDataFrame([(x,) for x in names], "x string").select(profiles.full_name(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == ["A B", "C", None, None, None, "Plain", None, None]
    plan = spark.range(1).select(profiles.full_name(F.col("id").cast("string")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1


def test_people_are_dealt_before_they_are_multiplied(spark):
    """A task's rows of shared things are bounded: tasks grow with the people, however few files they lie in."""
    people = spark.range(0, 1000, 1, 1)
    assert dedup.dealt(people, "id", rows=10).select(F.spark_partition_id()).distinct().count() > 50


def test_a_common_name_is_a_grid_of_cells(spark):
    """Classes of one name are judged by many tasks, with the same result for any size of a block."""
    people = spark.range(0, 240, 1, 1).select(
        F.concat(F.lit("p"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "asha").otherwise("asha rao").alias("name"), F.concat(F.lit("s"), F.col("id") % 120).alias("slug"), F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("phone"), F.array(F.lit("c")).alias("companies"), F.array().cast("array<string>").alias("threads"), (F.col("id") % 2).alias("degree"),
    )
    rows = lambda block: sorted(map(tuple, dedup.kept_distinct(people, block).collect()))
    assert rows(16) == rows(1000) and len(rows(16)) > 5000
    assert dedup.kept_distinct(people, 16).select(F.spark_partition_id()).distinct().count() > 2


def test_many_names_take_few_tasks_and_lists_are_compared_whole(spark):
    """Tasks grow with the pairs, not with the names; lists whose bits agree by chance are no shared item; an id is needed."""
    none = F.lit(None).cast("string")
    person = lambda k, name, company: k.select(F.concat(F.lit("p"), "id").alias("id"), name.alias("name"), none.alias("slug"), none.alias("email"), none.alias("phone"), F.array(company).alias("companies"), F.array(F.lit("t")).alias("threads"), F.lit(1).alias("degree"))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    assert dedup.kept_distinct(person(spark.range(400), letters, F.lit("c"))).rdd.getNumPartitions() == 4
    company = F.concat(F.lit("c"), F.col("id") % 150)
    rows = dedup.kept_distinct(person(spark.range(200), F.lit("asha"), company), 64).collect()
    assert len({(r["a"], r["b"]) for r in rows}) == len(rows) == 150 * 149 // 2 and sum(r["pairs"] for r in rows) == 200 * 199 // 2 - 50
    longer = person(spark.range(1), F.lit("asha rao"), F.lit("d")).withColumn("id", none)
    assert dedup.kept_distinct(person(spark.range(1), F.lit("asha"), F.lit("c")).unionByName(longer)).count() == 0
