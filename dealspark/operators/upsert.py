"""Upserts, replacements and deletes as joins over versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .finance import latest


def upsert_entities(base: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """(type, canonical, attrs) by key: attributes merged one by one, the newest value that isn't null wins.

    base, updates: (type, canonical, attrs MAP<STRING, STRING>, seq). Attributes are aggregated before a map is made."""
    both = base.unionByName(updates)
    each = both.select("type", "canonical", order, F.explode_outer("attrs").alias("k", "v"))
    best = each.where("k IS NULL OR v IS NOT NULL").groupBy("type", "canonical", "k").agg(F.max_by("v", order).alias("v"))
    return best.groupBy("type", "canonical").agg(F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["k"].isNotNull()))).alias("attrs"))


def upsert_edges(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert what is not there; null envelopes count as equal."""
    keys = ["src", "rel", "dst", "envelope_id"]
    new = updates.select(*keys).distinct()
    b = base.select(*[F.col(k).alias(f"_{k}") for k in keys])
    cond = (F.col("src") == F.col("_src")) & (F.col("rel") == F.col("_rel")) & (F.col("dst") == F.col("_dst")) & F.col("envelope_id").eqNullSafe(F.col("_envelope_id"))
    return base.select(*keys).unionByName(new.join(b, cond, "left_anti"))


def replace_observations(base: DataFrame, updates: DataFrame, source: str) -> DataFrame:
    """One source's rows of the (entity, metric) pairs in updates are replaced."""
    pairs = updates.select("entity_id", "metric").distinct().withColumn("_own", F.lit(source))
    kept = base.join(pairs, (base["entity_id"] == pairs["entity_id"]) & (base["metric"] == pairs["metric"]) & (base["source"] == pairs["_own"]), "left_anti")
    return kept.unionByName(updates)


def upsert_profiles(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    return latest(base.unionByName(updates), [key], F.col(order).desc_nulls_last())


def upsert_known(base: DataFrame, updates: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    return upsert_profiles(base, updates.join(known.select(key), key, "left_semi"), key, order)


def apply_actions(base: DataFrame, actions: DataFrame, allowed: list[str]) -> DataFrame:
    """Set stages by the latest valid action (id, stage, seq) of each id."""
    last = actions.where(F.col("stage").isin(*allowed)).groupBy("id").agg(F.max_by("stage", "seq").alias("new_stage"))
    return base.join(last, "id", "left").withColumn("stage", F.coalesce("new_stage", "stage")).drop("new_stage")


def apply_updates(companies: DataFrame, tasks: DataFrame, actions: DataFrame, stages: list[str]) -> tuple[DataFrame, DataFrame]:
    """(companies, tasks) after users' actions (target, what, value, seq): `stage` sets a company's pipeline_stage to one of
    stages, `owner` its deal_owner, `done` closes a task. Of each target and field the last valid one counts; an action on
    what is not there, of another kind, or to an unknown stage changes nothing.

    companies: (id, pipeline_stage, deal_owner, ...); tasks: (id, status, ...)."""
    valid = actions.where(F.col("what").isin("owner", "done") | ((F.col("what") == "stage") & F.col("value").isin(*stages)))
    last = valid.groupBy(F.col("target").cast("string").alias("_t"), "what").agg(F.max_by("value", "seq").alias("value"))
    wide = last.where("what <> 'done'").groupBy("_t").agg(F.max(F.when(F.col("what") == "stage", F.col("value"))).alias("_stage"), F.max(F.when(F.col("what") == "owner", F.col("value"))).alias("_owner"))
    done = last.where("what = 'done'").select("_t", F.lit(True).alias("_done"))
    at = F.col("id").cast("string") == F.col("_t")
    own = companies.join(wide.hint("merge"), at, "left").withColumns({"pipeline_stage": F.coalesce("_stage", "pipeline_stage"), "deal_owner": F.coalesce("_owner", "deal_owner")})
    closed = tasks.join(done.hint("merge"), at, "left").withColumn("status", F.when(F.col("_done"), "done").otherwise(F.col("status")))
    return own.drop("_t", "_stage", "_owner"), closed.drop("_t", "_done")


#: What an envelope owns, children first.
CHILDREN = ("chunk", "observation", "task", "edge", "attachment")


def delete_documents(tables: dict[str, DataFrame], wanted: DataFrame, source: str = "pdf") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the documents, report): each wanted envelope_id whose envelope is of `source` goes with all that came
    from it alone: its chunks, observations, tasks, edges, attachments, its envelope and its raw row. Entities stay.

    tables: those of CHILDREN that there are (with envelope_id), envelope (id, source, raw_id, ...), raw (id, storage_ref,
    ...), and others, which stay as they are. Report: (envelope_id, removed, reason, refs), refs being the stored objects
    that nothing else needs. Deleting again changes nothing."""
    asked = wanted.select(F.col("envelope_id").alias("_id")).distinct()
    env = tables["envelope"].select(F.col("id").alias("_e"), F.col("source").alias("_source"), F.col("raw_id").alias("_raw"))
    found = asked.join(env.hint("merge"), F.col("_id") == F.col("_e"), "left")
    gone = found.where(F.col("_source") == source).select("_id", "_raw")
    rest = lambda df, key, ids, of: df.join(ids.select(F.col(of).alias("_gone")).where("_gone IS NOT NULL").distinct().hint("merge"), F.col(key) == F.col("_gone"), "left_anti")
    out = {name: rest(df, "envelope_id", gone, "_id") if name in CHILDREN else df for name, df in tables.items()}
    out["envelope"] = rest(tables["envelope"], "id", gone, "_id")
    if "raw" in tables:
        out["raw"] = rest(tables["raw"], "id", gone, "_raw")
    refs = [tables["raw"].join(gone.hint("merge"), F.col("id") == F.col("_raw")).select("_id", F.col("storage_ref").alias("ref"))] if "raw" in tables else []
    refs += [tables["attachment"].join(gone.hint("merge"), F.col("envelope_id") == F.col("_id")).select("_id", F.col("storage_ref").alias("ref"))] if "attachment" in tables else []
    reason = F.when(F.col("_e").isNull(), "not found").when(~F.col("_source").eqNullSafe(F.lit(source)), f"not of source {source}")
    report = found.select("_id", reason.isNull().alias("removed"), reason.alias("reason"))
    if refs:
        every = refs[0].unionByName(refs[1]) if len(refs) > 1 else refs[0]
        lists = every.where("ref IS NOT NULL").groupBy("_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))  # a document's few objects
        report = report.join(lists.hint("merge"), "_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    return out, report.withColumnRenamed("_id", "envelope_id")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "envelope_id") -> dict[str, DataFrame]:
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}
