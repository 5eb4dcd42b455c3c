"""Streams with state, each beside the batch query that it equals: orphans, the spending gate, retries, live counts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import scalars as S
from ..sources.publish import publish, published, versions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """The session keeps the state of processors in RocksDB, which they need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# Raw items without an envelope --------------------------------------------------------------------------------------
def _matched(raw: DataFrame, envelopes: DataFrame, minutes: int) -> DataFrame:
    own = envelopes.select(F.col("source").alias("_s"), F.col("source_id").alias("_i"), "ingested_at")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("source_id") == F.col("_i")) & (F.col("ingested_at") >= F.col("received_at"))
    return raw.join(own.hint("merge"), on & (F.col("ingested_at") <= F.col("received_at") + F.expr(f"INTERVAL {minutes} MINUTES")), "left").where("_i IS NULL").drop("_s", "_i", "ingested_at")


def orphans(raw: DataFrame, envelopes: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Rows of raw (source, source_id, received_at) without an envelope (source, source_id, ingested_at) within `minutes` of
    their arrival, as far as these had passed at `as_of`. An item without an id never has an envelope."""
    due = F.col("received_at") + F.expr(f"INTERVAL {minutes} MINUTES") < F.lit(as_of).cast(raw.schema["received_at"].dataType)
    return _matched(raw.where(due), envelopes, minutes)


def stream_orphans(raw: DataFrame, envelopes: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """`orphans` of two streams: a row leaves once both watermarks (the newest time less `delay`) have passed its minutes,
    so state holds only rows that still may meet."""
    return _matched(raw.withWatermark("received_at", delay), envelopes.withWatermark("ingested_at", delay), minutes)


# The spending gate --------------------------------------------------------------------------------------------------
class Gate(StatefulProcessor):
    """Admits a day's items (id, at, usd) in order of time and id while all items so far, admitted or not, cost at most the
    cap. Only the admitted ones of a micro-batch are held, on a heap: once the sum passes the cap the latest goes."""

    def __init__(self, cap: float):
        self.cap = Decimal(str(cap))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent decimal(38,6)")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.spent.get()[0] if self.spent.exists() else Decimal(0)
        held, total, here, end = [], before, Decimal(0), None
        for r in rows:
            here += r.usd
            if end is not None and (r.at, r.id) > end:
                continue
            total += r.usd
            heapq.heappush(held, (_Latest((r.at, r.id)), r.usd))
            while self.cap and held and total > self.cap:  # the latest is refused, and so is all after it
                latest, usd = heapq.heappop(held)
                end, total = latest.value, total - usd
        self.spent.update((before + here,))
        self.handle.registerTimer(_day_end(key[0]))
        run = before
        for (at, ident), usd in sorted((x.value, usd) for x, usd in held):
            run += usd
            yield Row(id=ident, at=at, usd=usd, running=run)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Latest:
    """Orders a heap by the greatest value first."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return self.value > other.value


def _day_end(day) -> int:
    return int((day - type(day)(1970, 1, 1) + timedelta(days=1)).total_seconds() * 1000)


def stream_budget(items: DataFrame, cap: float, delay: str = "1 hour") -> DataFrame:
    """`gold.budget_admit` of a stream (id long, at timestamp, usd decimal, not negative) whose micro-batches follow in time
    order, split anywhere: a sum for each day is the state, and a timer at the day's end, by the watermark, drops it.
    A cap of 0 admits all."""
    with_state(items.sparkSession)
    rows = items.select("id", "at", F.col("usd").cast("decimal(18,6)").alias("usd"), F.to_date("at").alias("day")).withWatermark("at", delay)
    return rows.groupBy("day").transformWithState(Gate(cap), "id long, at timestamp, usd decimal(18,6), running decimal(38,6)", "Append", "EventTime")


# Retries and dead letters -------------------------------------------------------------------------------------------
def judged(deliveries: DataFrame, payload: str = "payload") -> DataFrame:
    """deliveries and `ok`: whether the payload is a JSON object."""
    return deliveries.withColumn("ok", F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False)))


OUTCOME = "key string, outcome string, attempts int, payload string"


class Retry(StatefulProcessor):
    """Counts a key's failed deliveries: the first good one ends it as good, the `limit`th failure as dead; what comes after
    the end is ignored. An ended key's mark lives `ttl`, so that state does not grow for ever."""

    def __init__(self, limit: int, ttl: timedelta | None):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # -1: ended
        self.failed = handle.getValueState("failed", "failed int", ttlDurationMs=int(self.ttl.total_seconds() * 1000) if self.ttl else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failed = held = self.failed.get()[0] if self.failed.exists() else 0
        for r in sorted(rows, key=lambda r: r.seq) if failed >= 0 else ():
            if not r.ok:
                failed += 1
            if r.ok or failed == self.limit:
                yield Row(key=key[0], outcome="good" if r.ok else "dead", attempts=failed + bool(r.ok), payload=r.payload)
                failed = -1
                break
        if failed != held:
            self.failed.update((failed,))

    def close(self) -> None:
        pass


def stream_retries(deliveries: DataFrame, limit: int = 5, ttl: timedelta | None = None) -> DataFrame:
    """(key, outcome, attempts, payload) of keys that have ended, from a stream of deliveries (key, seq, payload): a payload
    that parses after earlier failures is good with its number of attempts, one that fails `limit` times a dead letter.
    Deliveries of a key come in order of seq from one micro-batch to the next; a key's deliveries are few."""
    with_state(deliveries.sparkSession)
    rows = judged(deliveries.select(F.col("key").cast("string").alias("key"), "seq", "payload")).where("key IS NOT NULL")
    return rows.groupBy("key").transformWithState(Retry(limit, ttl), OUTCOME, "Append", "ProcessingTime" if ttl else "None")


def retry_outcomes(deliveries: DataFrame, limit: int = 5) -> DataFrame:
    """`stream_retries` of a batch. Keys are aggregated by their first good and their `limit`th delivery."""
    rows = judged(deliveries.select(F.col("key").cast("string").alias("key"), "seq", "payload")).where("key IS NOT NULL")
    w = Window.partitionBy("key").orderBy("seq")
    rows = rows.withColumns({"n": F.row_number().over(w), "good": F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ends = rows.where((F.col("ok") & (F.col("good") == 1) & (F.col("n") <= limit)) | (~F.col("ok") & (F.col("n") == limit) & (F.col("good") == 0)))
    return ends.select("key", F.when(F.col("ok"), "good").otherwise("dead").alias("outcome"), F.col("n").cast("int").alias("attempts"), "payload")


# Counts kept live ---------------------------------------------------------------------------------------------------
def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"), F.max("at").alias("newest"))


def merge_counts(root: str):
    """A batch writer that merges the counts that changed into the published table; a replayed batch changes nothing, as
    the counts are totals. A reader always sees one whole version."""

    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        if not versions(spark, root):
            publish(changed, root)
            return
        old = published(spark, root)
        kept = old.join(changed.select(F.col("status").alias("_s")).hint("merge"), F.col("status").eqNullSafe(F.col("_s")), "left_anti")
        publish(kept.unionByName(changed), root)

    return run


def keep_counts(log: DataFrame, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Counts by status of a stream (status, at), kept up to date in the table published at `root`: state holds a row for
    each status, each micro-batch sends the changed ones."""
    q = status_counts(log).writeStream.outputMode("update").foreachBatch(merge_counts(root)).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()


def counts_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The same counts as the query's state has them, read by the state data source."""
    return spark.read.format("statestore").load(checkpoint).select(F.col("key.status").alias("status"), F.col("value.count").alias("n"))
