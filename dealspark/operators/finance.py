"""Financial histories: joins, latest values, tracks and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def company_financials(observations: DataFrame, entities: DataFrame, verified_sources: tuple[str, ...] = ("registry",)) -> DataFrame:
    """Observations of companies that have a value, with their track: verified by confidence or by where they come from,
    else management."""
    companies = entities.where("type = 'company'").select(F.col("id").alias("entity_id"), F.col("canonical").alias("company"))
    from_source = F.lower("source").rlike("^(" + "|".join(verified_sources) + ")")
    track = F.when((F.col("confidence") == "Verified") | from_source, "verified").otherwise("management")
    return observations.where("value_num IS NOT NULL").join(companies, "entity_id").withColumn("track", track)


def confidence_rank(c: str = "confidence") -> Column:
    return F.when(F.col(c) == "Verified", 4).when(F.col(c) == "High", 3).when(F.col(c) == "Medium", 2).otherwise(1)


def financials_latest(financials: DataFrame) -> DataFrame:
    return latest(financials, ["entity_id", "metric", "track"], F.col("as_of").desc_nulls_last(), confidence_rank().desc(), F.col("created_at").desc(), F.col("id").desc())


def observation_latest(observations: DataFrame) -> DataFrame:
    """Of High and Verified rows only."""
    return latest(observations.where(F.col("confidence").isin("High", "Verified")), ["entity_id", "metric"], F.col("as_of").desc_nulls_last(), F.col("id").desc())


def financial_series(financials: DataFrame) -> DataFrame:
    """Rows numbered by time within (entity, metric, track), labelled by their period, else by month, else blank."""
    w = Window.partitionBy("entity_id", "metric", "track").orderBy(F.col("as_of").asc_nulls_first(), "id")
    return financials.withColumn("n", F.row_number().over(w)).withColumn("label", F.coalesce(F.nullif(F.col("period"), F.lit("")), F.date_format("as_of", "yyyy-MM"), F.lit("")))


def metric_max(observations: DataFrame, metrics: list[str]) -> DataFrame:
    return observations.groupBy("entity_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value_num"))).alias(f"max_{m}") for m in metrics])


def val_rev_multiple(latest_financials: DataFrame) -> DataFrame:
    """Valuation over revenue, verified track only, one decimal; null without revenue."""
    own = latest_financials.where("track = 'verified' AND metric IN ('valuation', 'revenue')")
    wide = own.groupBy("entity_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value_num"))).alias(m) for m in ("valuation", "revenue")])
    return wide.select("entity_id", F.round(F.try_divide("valuation", "revenue"), 1).alias("multiple"))
