"""Structured Streaming: landing, normalising, status counts and dead letters with the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as N
from ..operators.numbering import numbered


def stream_normalize(raw: DataFrame) -> DataFrame:
    """Raw rows to gated envelopes; the same code serves a batch."""
    return N.apply_gate(N.normalize(raw).withColumn("signal_score", N.signal_score()))


def stream_land(raw: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Redelivered native ids within the watermark go; beyond it, foreach_land keeps them out of the target."""
    return raw.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def foreach_land(path: str, schema, order: str | None = None):
    """A batch writer that appends only what the target has not, of several rows of an id the first in order (then that of
    the least hash): a replayed batch is a no-op. The target is created at the first batch."""
    import pyspark.sql.types as T

    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    first = Window.partitionBy("source", "source_id").orderBy(*([order] if order else []), F.xxhash64(*[F.col(f.name) for f in kind]))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        target = spark.read.schema(kind).option("pathGlobFilter", "*.parquet").parquet(path)
        one = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        same = (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("source_id").eqNullSafe(F.col("_i")))
        one.join(target.select(F.col("source").alias("_s"), F.col("source_id").alias("_i")).hint("merge"), same, "left_anti").select(*[f.name for f in kind]).write.mode("append").parquet(path)

    return run


def split_dead_letters(df: DataFrame, column: str, schema: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with `parsed`, dead letters with stage, payload and error)."""
    ok = F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"[}\]]\s*$")
    good = df.where(ok).withColumn("parsed", F.from_json(column, schema))
    return good, df.where(~ok | F.col(column).isNull()).select(F.lit(stage).alias("stage"), F.col(column).alias("payload"), F.lit("not JSON").alias("error"))


def stream_status(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("status").agg(F.count("*").alias("n"))


def stage_stream(df: DataFrame, status: str, step) -> DataFrame:
    """A stage acts on rows of its status only."""
    return df.where(F.col("status") == status).transform(step)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, as Parquet."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, each micro-batch as a batch through `step`, for what a stream can't join or group by itself. A
    micro-batch has its own folder of Parquet under path (`batch=`), so one that is replayed replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    q = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


NEXT_STAGE = {"raw": "normalize", "normalized": "preprocess", "preprocessed": "extract", "extracted": "embed", "embedded": "resolve", "resolved": "resolve"}


def stuck_items(log: DataFrame, as_of: str, minutes: int = 20, cap: int = 500) -> DataFrame:
    """Rows in a status with a next stage for longer than `minutes`, oldest first, with that stage."""
    stage = F.create_map(*[F.lit(x) for kv in NEXT_STAGE.items() for x in kv])
    out = log.withColumn("next_stage", F.try_element_at(stage, F.col("status"))).where(F.col("next_stage").isNotNull())
    return out.where(F.col("at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")).orderBy("at", "id").limit(cap)


def batches(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """Rows numbered into batches of n within a key, by a total order; a hot key is numbered by many tasks."""
    return numbered(df, [key], [order], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / n)).drop("_n")
