"""Gold tables, digests, rankings and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .finance import latest, metric_max
from .numbering import numbered


def latest_note(notes: DataFrame, by: str = "occurred_at") -> DataFrame:
    return latest(notes, ["company_name"], F.col(by).desc_nulls_last(), F.col("id").desc())


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("company_name").agg(F.count("*").alias("n_notes"), F.max("occurred_at").alias("last_interaction"), F.min("occurred_at").alias("first_seen"))


def has_deal(ask="ask", round_type="round_type"):
    return F.col(ask).isNotNull() | F.col(round_type).isNotNull()


def company_card(notes: DataFrame, entities: DataFrame, observations: DataFrame) -> DataFrame:
    """Latest note's texts, counts, and the greatest value ever of each metric where the note has no number."""
    own = entities.where("type = 'company'").select(F.col("id").alias("entity_id"), F.col("canonical").alias("company_name"))
    card = latest_note(notes).select("company_name", "sector", "ask", "round_type").join(own, "company_name", "left").join(note_counts(notes), "company_name", "left")
    card = card.join(metric_max(observations, ["revenue", "ebitda", "valuation", "funding_ask"]), "entity_id", "left")
    return card.select("entity_id", "company_name", "sector", F.coalesce("ask", "max_funding_ask").alias("ask"), "round_type", "n_notes", "last_interaction", "max_revenue", "max_ebitda", "max_valuation", has_deal().alias("has_deal"))


def deal_card(card: DataFrame) -> DataFrame:
    return card.where("has_deal")


def dashboard_stats(card: DataFrame, entities: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of totals."""
    a = card.agg(F.count("*").alias("companies"), F.countDistinct("sector").alias("sectors"), F.count_if("has_deal").alias("deals"), F.round(F.sum(F.col("ask").cast("decimal(20,2)")), 2).alias("total_ask"))
    b = entities.agg(F.count_if(F.col("type") == "investor").alias("investors"), F.count_if(F.col("type") == "person").alias("people"))
    return a.crossJoin(b).crossJoin(notes.agg(F.count("*").alias("notes")))


def stage_of(round_type="round_type"):
    return F.coalesce(F.substring(round_type, 1, 1), F.lit("0"))


def kanban(pipeline: DataFrame, stages: list[str]) -> DataFrame:
    """Count and sum by stage, with every stage present."""
    every = pipeline.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    got = pipeline.where(F.col("stage").isin(stages)).groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("ask").cast("decimal(20,2)")).alias("total"))
    return every.join(F.broadcast(got), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0).cast("decimal(30,2)")).alias("total"))


def deal_pipeline(card: DataFrame) -> DataFrame:
    return card.where("has_deal").select("entity_id", "company_name", stage_of().alias("stage"), "ask", "last_interaction")


def crm_pipeline(entities: DataFrame, latest_obs: DataFrame) -> DataFrame:
    revenue = latest_obs.where("metric = 'revenue'").select(F.col("entity_id").alias("id"), F.col("value_num").alias("revenue"))
    return entities.where("type = 'company'").join(revenue, "id", "left").select("id", "canonical", "sector", "revenue")


def open_tasks(tasks: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    names = entities.where("type = 'company'").select(F.col("id").alias("company_id"), F.col("canonical").alias("company"))
    rows = tasks.where(~F.col("status").isin("done", "closed", "cancelled"))
    return rows.join(names, "company_id", "left").withColumn("overdue", F.col("due_date") < F.lit(as_of).cast("date"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def digest(tasks: DataFrame, card: DataFrame, firsts: DataFrame, as_of: str, quiet_days: int = 21) -> dict[str, DataFrame]:
    """Sections: overdue, due_soon, new, quiet, fresh; each a top list in a total order."""
    day = F.lit(as_of).cast("date")
    soon, week = F.date_add(day, 7), F.date_sub(day, 7)
    return {
        "overdue": top(tasks.where("overdue"), 25, "due_date", "id"),
        "due_soon": top(tasks.where(F.col("due_date").between(day, soon)), 25, "due_date", "id"),
        "new": top(firsts.where(F.col("first_seen").between(week, day)), 25, F.desc("first_seen"), "company_name"),
        "quiet": top(card.where(F.col("has_deal") & (F.col("last_interaction") < F.date_sub(day, quiet_days))), 20, "last_interaction", "company_name"),
        "fresh": top(tasks.where(F.col("created_at").between(week, day)), 25, F.desc("created_at"), "id"),
    }


def list_companies(card: DataFrame) -> DataFrame:
    return card.orderBy(F.col("last_interaction").desc_nulls_last(), "company_name")


def list_deals(card: DataFrame) -> DataFrame:
    return deal_card(card).orderBy(F.col("ask").desc_nulls_last(), "company_name")


def sort_companies(card: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Blanks count as less than any number."""
    c = F.col(key)
    return card.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), "company_name")


def filter_companies(card: DataFrame, sector: str | None = None, deals_only: bool = False, text: str | None = None, stage: str | None = None, poc: str | None = None) -> DataFrame:
    """Rows that fit all given; text is sought in any case in name, sector and, where the card has them, summary, aliases
    (an array) and owner."""
    for column, want in (("sector", sector), ("stage", stage), ("poc", poc)):
        card = card.where(F.col(column) == want) if want else card
    card = card.where("has_deal") if deals_only else card
    kept = [c for c in ("company_name", "sector", "summary", "aliases", "poc") if c in card.columns]
    return card.where(F.contains(F.lower(F.concat_ws(" ", *kept)), F.lit(text.lower()))) if text else card


def facets(card: DataFrame, column: str = "sector") -> DataFrame:
    return card.where(F.col(column).isNotNull()).select(column).distinct()


def pipeline_status(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


def spend_by_day(cost: DataFrame, cap: float) -> DataFrame:
    """Spend by day, and whether it reached the cap (0: no cap)."""
    got = cost.groupBy(F.to_date("at").alias("day")).agg(F.sum("usd").alias("spent"))
    return got.withColumn("exceeded", (F.lit(cap) > 0) & (F.col("spent") >= cap))


def budget_admit(items: DataFrame, cap: float) -> DataFrame:
    """Items whose running spend within the day stays within the cap; 0: all.

    In two passes: sums of each minute give what was spent before it in its day, and items are summed within their minute
    only, so that no task gets a whole day."""
    minute, day = F.date_trunc("minute", "at"), F.to_date("at")
    sums = items.groupBy(day.alias("_day"), minute.alias("_m")).agg(F.sum("usd").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("_day").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_m").alias("_minute"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("usd").over(Window.partitionBy("_m").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    run = items.withColumn("_m", minute).withColumn("_own", own).join(sums.hint("merge"), F.col("_m").eqNullSafe(F.col("_minute")))
    return run.withColumn("running", F.col("_own") + F.col("_before")).drop("_m", "_own", "_minute", "_before").where((F.lit(cap) == 0) | (F.col("running") <= cap))


def ops_metrics(log: DataFrame, as_of: str) -> DataFrame:
    """Share of skipped rows and days since the newest row, by source."""
    g = log.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.max("at").alias("newest"))
    return g.select("source", "n", F.round(F.col("skipped") / F.col("n"), 4).alias("skip_rate"), F.date_diff(F.lit(as_of).cast("date"), F.col("newest").cast("date")).alias("age_days"))


def unique_names(df: DataFrame, name: str, ident: str) -> DataFrame:
    """The second and later rows of a name get their id as suffix."""
    first = F.concat(F.col(name), F.lit("-"), F.col(ident).cast("string"))
    return numbered(df, [name], [ident], "_n").withColumn("unique_name", F.when(F.col("_n") > 1, first).otherwise(F.col(name))).drop("_n")


def latest_non_empty(df: DataFrame, key: str, columns: list[str], order: str, ident: str) -> DataFrame:
    """For each key the last value of each column that is neither null nor blank."""
    at = F.struct(order, ident)
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull(), at)).alias(c) for c in columns])


def merge_lists(df: DataFrame, key: str, column: str, order: str, ident: str, size: int = 10_000) -> DataFrame:
    """(key, block, column): all distinct list items of a key by first appearance, in lists of `size` numbered from 0, so that
    no row grows with a key; items are aggregated before the lists are made."""
    items = df.select(key, F.explode(column).alias("item"), F.struct(order, ident).alias("at")).groupBy(key, "item").agg(F.min("at").alias("at"))
    ranked = numbered(items, [key], ["at", "item"]).withColumn("block", F.floor((F.col("n") - 1) / size))
    return ranked.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias(column))


def merge_people(mentions: DataFrame, internal: DataFrame | None = None) -> DataFrame:
    """One row per person: gaps filled by the earliest value, the company by the newest mention; one of internal (person)
    keeps the company of the first mention, as colleagues are named in notes of every company."""
    at = F.struct("at", "id")
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    out = mentions.groupBy("person").agg(F.min_by("role", known("role")).alias("role"), F.max_by("company", known("company")).alias("company"), F.min_by("company", known("company")).alias("_first"), F.count("*").alias("mentions"))
    if internal is not None:
        own = internal.select(F.col("person").alias("_p")).distinct()
        out = out.join(own.hint("merge"), F.col("person") == F.col("_p"), "left").withColumn("company", F.when(F.col("_p").isNotNull(), F.col("_first")).otherwise(F.col("company"))).drop("_p")
    return out.drop("_first")


def placed_pipeline(card: DataFrame, placed: DataFrame, first: str = "Sourced") -> DataFrame:
    """(entity_id, company_name, stage, owner, ask, has_deal): companies with a deal, and those that someone placed on the
    board (placed: entity_id, pipeline_stage, deal_owner); a deal that no one placed is at the first stage."""
    own = placed.select("entity_id", "pipeline_stage", "deal_owner", F.lit(True).alias("_on"))
    out = card.join(own.hint("merge"), "entity_id", "left").where(F.col("has_deal") | (F.col("_on") & F.col("pipeline_stage").isNotNull()))
    return out.select("entity_id", "company_name", F.coalesce("pipeline_stage", F.lit(first)).alias("stage"), F.col("deal_owner").alias("owner"), "ask", "has_deal")


def spend_by_model(cost: DataFrame) -> DataFrame:
    """(day, model, calls, tokens_in, tokens_out, usd) of calls (at, model, tokens_in, tokens_out, usd)."""
    total = lambda c: F.sum(c).alias(c)
    return cost.groupBy(F.to_date("at").alias("day"), "model").agg(F.count("*").alias("calls"), total("tokens_in"), total("tokens_out"), total("usd"))


def ops_sketches(log: DataFrame, lg_k: int = 12) -> DataFrame:
    """A row for each source and day of log (source, at, status, content_hash, usd): counts, spend, the newest time and a
    sketch of the distinct contents of 2^lg_k registers. Rows of other days or of more logs can be added by union."""
    queued = F.col("status").isin("raw", "normalized", "preprocessed", "extracted", "embedded")
    return log.groupBy("source", F.to_date("at").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(queued).alias("queued"), F.sum("usd").alias("usd"), F.max("at").alias("newest"), F.hll_sketch_agg("content_hash", F.lit(lg_k)).alias("contents"),
    )


def ops_figures(sketches: DataFrame, as_of: str) -> DataFrame:
    """The five figures of each source, from sketches of any days: the share of rows skipped and of rows whose content came
    before (estimated: a standard error of 1.04 / sqrt(2^lg_k) of the distinct count), days since the newest row, rows that
    wait for a stage, and spend."""
    g = sketches.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "skipped", "queued", "usd")], F.max("newest").alias("newest"), F.hll_sketch_estimate(F.hll_union_agg("contents")).alias("distinct"))
    rate = lambda x: F.round(x / F.col("n"), 4)
    return g.select("source", "n", rate(F.col("skipped")).alias("skip_rate"), F.greatest(rate(F.col("n") - F.col("distinct")), F.lit(0.0)).alias("collision_rate"), F.date_diff(F.lit(as_of).cast("date"), F.col("newest").cast("date")).alias("age_days"), "queued", "usd")
