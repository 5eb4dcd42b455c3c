"""Sinks: JSON lines, CSV and the fan-out of a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def foreach_batch_fanout(sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Give a batch to every sink; one that fails does not block the others, and the first failure is raised at the end."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        failed = []
        for sink in sinks:
            try:
                sink(batch, batch_id)
            except Exception as e:  # the others still get the batch
                failed.append(e)
        batch.unpersist()
        if failed:
            raise failed[0]

    return run
