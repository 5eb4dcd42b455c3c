"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspark.llm import decontaminate, mixing, pii, simhash, toxicity
from dealspark.llm.common import release, stored, table


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the changed text."""
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else after


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is fitted on the labelled ones of `docs`. Null and empty texts stay,
    repeated rows are judged alike, null ids are never learnt from; without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id (null last); of rows alike one. Null and empty
    texts are one group, very long ones are fingerprinted whole. Extra columns come along under their names."""
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which half or more is one goes. Null and empty texts stay, as does
    everything if the benchmark is empty; other texts stay byte by byte, ties and repeated rows are treated alike."""
    return _counted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every row stays, null texts as null, in the whole of very long texts. Repeated rows are masked
    alike, an empty table stays empty, extra columns come along under their names."""
    return _counted(docs, pii.redact(docs, pii.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`, how often. Null sources are one source, null texts have no size, rows
    alike are decided alike. An empty table gives none. Extra columns come along under their names, but for one called
    `copies`, which is replaced."""
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", cut_benchmark), ("personal_data", mask_personal_data), ("mixing", mix_sources)]
#: Trained scores and fingerprints are not SQL; tests/llm/test_pipeline.py holds each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one's is written. Empty tables give an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
