"""A hot key's partition is split in the final plan of the joins that meet it, and the rows stay right."""

import pytest
from pyspark.sql import functions as F

from dealspark.llm import simhash, warc
from dealspark.llm.common import stored

SPLIT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def low_thresholds(spark):
    held = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def split(df) -> bool:
    df.collect()
    return "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_digest(spark, low_thresholds):
    rows = spark.range(0, 30_000, 1, 12).select(F.col("id").alias("_id"), F.unhex(F.sha1(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.floor(F.col("id") / 2).cast("string")).cast("binary"))).alias("_digest"))
    narrow = stored(rows, "t")
    first = narrow.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("_digest", "_d")
    out = warc.later(narrow, stored(first, "t"))
    assert split(out) and out.count() == warc.later(narrow, first).count() >= 9_999
    assert not split(warc.later(narrow, first)), "an aggregate right under the join keeps the hot partition whole"


def test_hot_star(spark, low_thresholds):
    ends = stored(spark.range(0, 30_000, 1, 12).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("u"), (F.col("id") + 100_000).alias("v")), "t")
    least = stored(ends.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "t")
    out = simhash.star(ends, least)
    assert split(out) and out.count() == 30_000 and out.where("u = -1 AND m <> 100000").isEmpty()
