"""Row numbers within a key that no single task has to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """df with `name`, each row's number from 1 within its keys by `order`, as row_number() over one window would give.

    Rows are dealt by ranges of keys and order and written; each range numbers its own rows, from the count of the ranges
    before it, of which there are as many as partitions and keys. So a key of any size is spread over tasks. Null keys are
    a key. The order must be total for reruns to agree."""
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before")))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(starts.hint("merge"), on).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])
