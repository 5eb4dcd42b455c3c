"""The registered queries over the derived tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checkpoints, dedup, finance, gold, graph, knowledge, normalize, search, text, upsert
from ..sources import raw
from ..streaming import streams
from .derived import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-06-01"


def query(oracle: str | None = None, *names: str):
    """Register a function of Tables; oracle: SQL over the derived tables named."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *names)
        return f

    return add


# Finance ------------------------------------------------------------------------------------------------------------
FIN = "SELECT o.*, c.canonical AS company, CASE WHEN confidence = 'Verified' OR lower(source) LIKE 'registry%' THEN 'verified' ELSE 'management' END AS track FROM observation o JOIN company c ON c.id = o.entity_id WHERE value_num IS NOT NULL"
RANK = "CASE confidence WHEN 'Verified' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"


def financials(t: Tables) -> DataFrame:
    return finance.company_financials(t.observation(), t.company())


@query(f"WITH f AS ({FIN}) SELECT entity_id, metric, track, value_num, CAST(as_of AS VARCHAR) AS as_of FROM f QUALIFY row_number() OVER (PARTITION BY entity_id, metric, track ORDER BY as_of DESC NULLS LAST, {RANK} DESC, created_at DESC, id DESC) = 1", "observation", "company")
def financials_latest(t):
    return finance.financials_latest(financials(t)).select("entity_id", "metric", "track", "value_num", F.col("as_of").cast("string").alias("as_of"))


@query("SELECT entity_id, metric, value_num, confidence FROM observation WHERE confidence IN ('High', 'Verified') QUALIFY row_number() OVER (PARTITION BY entity_id, metric ORDER BY as_of DESC NULLS LAST, id DESC) = 1", "observation")
def observation_latest(t):
    return finance.observation_latest(t.observation()).select("entity_id", "metric", "value_num", "confidence")


@query(f"WITH f AS ({FIN}) SELECT id, entity_id, metric, track, row_number() OVER (PARTITION BY entity_id, metric, track ORDER BY as_of NULLS FIRST, id) AS n, coalesce(nullif(period, ''), strftime(as_of, '%Y-%m'), '') AS label FROM f", "observation", "company")
def financial_series(t):
    return finance.financial_series(financials(t)).select("id", "entity_id", "metric", "track", "n", "label")


@query(f"WITH f AS ({FIN}), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity_id, metric, track ORDER BY as_of DESC NULLS LAST, {RANK} DESC, created_at DESC, id DESC) = 1) SELECT entity_id, round(max(value_num) FILTER (metric = 'valuation') / max(value_num) FILTER (metric = 'revenue'), 1) AS multiple FROM l WHERE track = 'verified' AND metric IN ('valuation', 'revenue') GROUP BY entity_id", "observation", "company")
def val_rev_multiple(t):
    return finance.val_rev_multiple(finance.financials_latest(financials(t)))


@query("SELECT entity_id, max(value_num) FILTER (metric = 'revenue') AS max_revenue, max(value_num) FILTER (metric = 'ebitda') AS max_ebitda FROM observation GROUP BY entity_id", "observation")
def metric_max(t):
    return finance.metric_max(t.observation(), ["revenue", "ebitda"])


# Gold tables --------------------------------------------------------------------------------------------------------
LATEST = "ln AS (SELECT * FROM note QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY occurred_at DESC NULLS LAST, id DESC) = 1), nc AS (SELECT company_name, count(*) AS n_notes, max(occurred_at) AS last_interaction, min(occurred_at) AS first_seen FROM note GROUP BY company_name), mx AS (SELECT entity_id, max(value_num) FILTER (metric = 'revenue') AS max_revenue, max(value_num) FILTER (metric = 'ebitda') AS max_ebitda, max(value_num) FILTER (metric = 'valuation') AS max_valuation, max(value_num) FILTER (metric = 'funding_ask') AS max_ask FROM observation GROUP BY entity_id), card AS (SELECT c.id AS entity_id, ln.company_name, ln.sector, coalesce(ln.ask, max_ask) AS ask, ln.round_type, n_notes, last_interaction, first_seen, max_revenue, max_ebitda, max_valuation, coalesce(ln.ask, max_ask) IS NOT NULL AND ln.ask IS NOT NULL OR ln.round_type IS NOT NULL AS has_deal FROM ln LEFT JOIN company c ON c.canonical = ln.company_name LEFT JOIN nc USING (company_name) LEFT JOIN mx ON mx.entity_id = c.id)"
CARD = ("note", "company", "observation")
COLS = "entity_id, company_name, sector, ask, round_type, n_notes, CAST(last_interaction AS VARCHAR) AS last_interaction, max_revenue, max_ebitda, max_valuation, has_deal"


def card(t: Tables) -> DataFrame:
    return gold.company_card(t.note(), t.company(), t.observation())


def dated(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query(f"WITH {LATEST} SELECT {COLS} FROM card", *CARD)
def company_card(t):
    return dated(card(t), "last_interaction")


@query(f"WITH {LATEST} SELECT {COLS} FROM card WHERE has_deal", *CARD)
def deal_card(t):
    return dated(gold.deal_card(card(t)), "last_interaction")


@query(f"WITH {LATEST} SELECT count(*) AS companies, count(DISTINCT sector) AS sectors, count(*) FILTER (has_deal) AS deals, CAST(sum(CAST(ask AS DECIMAL(20, 2))) AS DOUBLE) AS total_ask, (SELECT count(*) FROM entity WHERE type = 'investor') AS investors, (SELECT count(*) FROM entity WHERE type = 'person') AS people, (SELECT count(*) FROM note) AS notes FROM card", *CARD, "entity")
def dashboard_stats(t):
    return gold.dashboard_stats(card(t), t.entity(), t.note()).withColumn("total_ask", F.col("total_ask").cast("double"))


@query("WITH l AS (SELECT * FROM observation WHERE confidence IN ('High', 'Verified') QUALIFY row_number() OVER (PARTITION BY entity_id, metric ORDER BY as_of DESC NULLS LAST, id DESC) = 1) SELECT c.id, canonical, sector, value_num AS revenue FROM company c LEFT JOIN l ON l.entity_id = c.id AND l.metric = 'revenue'", "observation", "company")
def crm_pipeline(t):
    return gold.crm_pipeline(t.company(), finance.observation_latest(t.observation()))


@query(f"WITH {LATEST} SELECT entity_id, company_name, coalesce(substr(round_type, 1, 1), '0') AS stage, ask, CAST(last_interaction AS VARCHAR) AS last_interaction FROM card WHERE has_deal", *CARD)
def deal_pipeline(t):
    return dated(gold.deal_pipeline(card(t)), "last_interaction")


@query(f"WITH {LATEST}, p AS (SELECT coalesce(substr(round_type, 1, 1), '0') AS stage, ask FROM card WHERE has_deal), s AS (SELECT CAST(unnest(range(7)) AS VARCHAR) AS stage) SELECT s.stage, count(p.stage) AS n, CAST(coalesce(sum(CAST(ask AS DECIMAL(20, 2))), 0) AS DOUBLE) AS total FROM s LEFT JOIN p USING (stage) GROUP BY s.stage", *CARD)
def kanban(t):
    return gold.kanban(gold.deal_pipeline(card(t)), [str(i) for i in range(7)]).withColumn("total", F.col("total").cast("double"))


@query(f"WITH {LATEST} SELECT DISTINCT sector FROM card WHERE sector IS NOT NULL", *CARD)
def facets(t):
    return gold.facets(card(t))


@query(f"WITH {LATEST} SELECT company_name, ask FROM card WHERE has_deal AND sector = 'BUILDING' AND contains(lower(company_name || ' ' || sector), 'customer')", *CARD)
def filter_companies(t):
    return gold.filter_companies(card(t), "BUILDING", True, "Customer").select("company_name", "ask")


@query(f"WITH {LATEST} SELECT company_name FROM card WHERE has_deal ORDER BY ask DESC NULLS LAST, company_name", *CARD)
def list_deals(t):
    return gold.list_deals(card(t)).select("company_name")


@query("SELECT company_name, CAST(count(*) AS BIGINT) AS n_notes, CAST(min(occurred_at) AS VARCHAR) AS first_seen FROM note GROUP BY company_name", "note")
def first_seen(t):
    return gold.note_counts(t.note()).select("company_name", "n_notes", F.col("first_seen").cast("string").alias("first_seen"))


@query("SELECT id, company_name, CAST(occurred_at AS VARCHAR) AS occurred_at FROM note QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY ingested_at DESC NULLS LAST, id DESC) = 1", "note")
def latest_facts(t):
    return dated(gold.latest_note(t.note(), "ingested_at"), "occurred_at").select("id", "company_name", "occurred_at")


@query("SELECT company_name AS company, max_by(round_type, (occurred_at, id)) FILTER (round_type IS NOT NULL) AS round_type, max_by(ask, (occurred_at, id)) FILTER (ask IS NOT NULL) AS ask FROM note GROUP BY 1", "note")
def vault_companies(t):
    return gold.latest_non_empty(t.note(), "company_name", ["round_type", "ask"], "occurred_at", "id").withColumnRenamed("company_name", "company")


# Tasks and digest ---------------------------------------------------------------------------------------------------
TASKS = f"ot AS (SELECT t.*, c.canonical AS company, due_date < DATE '{AS_OF}' AS overdue FROM task t LEFT JOIN company c ON c.id = t.company_id WHERE status NOT IN ('done', 'closed', 'cancelled'))"


def tasks(t: Tables) -> DataFrame:
    return gold.open_tasks(t.task(), t.company(), AS_OF)


def section(t: Tables, name: str) -> DataFrame:
    return gold.digest(tasks(t), card(t), gold.note_counts(t.note()), AS_OF)[name]


@query(f"WITH {TASKS} SELECT id, company, CAST(due_date AS VARCHAR) AS due_date, overdue FROM ot", "task", "company")
def open_tasks(t):
    return dated(tasks(t), "due_date").select("id", "company", "due_date", "overdue")


@query(f"WITH {TASKS} SELECT id, company FROM ot WHERE overdue ORDER BY due_date, id LIMIT 25", "task", "company")
def digest_overdue(t):
    return section(t, "overdue").select("id", "company")


@query(f"WITH {TASKS} SELECT id, company FROM ot WHERE due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7 ORDER BY due_date, id LIMIT 25", "task", "company")
def digest_due_soon(t):
    return section(t, "due_soon").select("id", "company")


@query(f"WITH {LATEST} SELECT company_name FROM nc WHERE first_seen BETWEEN DATE '1995-01-20' - 7 AND DATE '1995-01-20' ORDER BY first_seen DESC, company_name LIMIT 25", *CARD)
def digest_new(t):
    return gold.digest(tasks(t), card(t), gold.note_counts(t.note()), "1995-01-20")["new"].select("company_name")


@query(f"WITH {LATEST} SELECT company_name FROM card WHERE has_deal AND last_interaction < DATE '{AS_OF}' - 21 ORDER BY last_interaction, company_name LIMIT 20", *CARD)
def digest_quiet(t):
    return section(t, "quiet").select("company_name")


@query(f"WITH {TASKS} SELECT id FROM ot WHERE created_at BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}' ORDER BY created_at DESC, id LIMIT 25", "task", "company")
def digest_fresh(t):
    return section(t, "fresh").select("id")


@query(f"WITH {TASKS} SELECT id FROM ot ORDER BY overdue DESC, due_date, created_at DESC, id LIMIT 50", "task", "company")
def inbox(t):
    return gold.top(tasks(t), 50, F.desc("overdue"), "due_date", F.desc("created_at"), "id").select("id")


# Operations ---------------------------------------------------------------------------------------------------------
def status_log(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "skipped").otherwise(F.col("event_type")).alias("status"), F.col("event_type").alias("source"), F.col("ts").alias("at"), (F.col("value") / 10000).cast("decimal(12,6)").alias("usd"))


LOG = "lg AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'skipped' ELSE event_type END AS status, event_type AS source, ts AS tm, CAST(value / 10000 AS DECIMAL(12, 6)) AS usd FROM events)"


@query(f"WITH {LOG} SELECT status, count(*) AS n, CAST(min(tm) AS DATE)::VARCHAR AS oldest, CAST(max(tm) AS DATE)::VARCHAR AS newest FROM lg GROUP BY status")
def pipeline_status(t):
    df = gold.pipeline_status(status_log(t))
    return df.select("status", "n", F.to_date("oldest").cast("string").alias("oldest"), F.to_date("newest").cast("string").alias("newest"))


@query(f"WITH {LOG} SELECT CAST(CAST(tm AS DATE) AS VARCHAR) AS day, CAST(sum(usd) AS DOUBLE) AS spent, sum(usd) >= 1.5 AS exceeded FROM lg GROUP BY 1")
def spend_by_day(t):
    return gold.spend_by_day(status_log(t), 1.5).select(F.col("day").cast("string").alias("day"), F.col("spent").cast("double").alias("spent"), "exceeded")


@query(f"WITH {LOG} SELECT id FROM (SELECT id, sum(usd) OVER (PARTITION BY CAST(tm AS DATE) ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS running FROM lg) WHERE running <= 1.5")
def budget_admit(t):
    return gold.budget_admit(status_log(t), 1.5).select("id")


@query(f"WITH {LOG} SELECT source, count(*) AS n, round(count(*) FILTER (status = 'skipped') / count(*), 4) AS skip_rate, DATE '2024-02-10' - CAST(max(tm) AS DATE) AS age_days FROM lg GROUP BY source")
def ops_metrics(t):
    return gold.ops_metrics(status_log(t), "2024-02-10")


@query(f"WITH {LOG} SELECT id, 'preprocess' AS next_stage FROM (SELECT id, tm, CASE WHEN source = 'view' THEN 'normalized' ELSE source END AS st FROM lg) WHERE st = 'normalized' AND tm < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 20 MINUTES ORDER BY tm, id LIMIT 500")
def stuck_items(t):
    log = status_log(t).withColumn("status", F.when(F.col("source") == "view", "normalized").otherwise(F.col("source")))
    return streams.stuck_items(log, "2024-01-20 00:00:00").select("id", "next_stage")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 50 <> 0")
def dead_letters_good(t):
    bad = F.when(F.col("event_id") % 50 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return streams.split_dead_letters(t.events.select("event_id", bad.alias("props")), "props", "k bigint", "parse")[0].select("event_id", "parsed.k")


@query("SELECT 'parse' AS stage, substr(props, 1, length(props) - 1) AS payload, 'not JSON' AS error FROM events WHERE event_id % 50 = 0")
def dead_letters(t):
    bad = F.when(F.col("event_id") % 50 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return streams.split_dead_letters(t.events.select(bad.alias("props")), "props", "k bigint", "parse")[1]


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS batch FROM events")
def batches(t):
    return streams.batches(t.events, 100, "event_type", "event_id").select("event_id", "batch")


# Graph --------------------------------------------------------------------------------------------------------------
@query("SELECT src AS investor, dst AS company FROM invests_in", "invests_in")
def investor_portfolio(t):
    return t.invests_in().select(F.col("src").alias("investor"), F.col("dst").alias("company"))


@query("SELECT src AS investor, count(DISTINCT dst) AS portfolio FROM invests_in GROUP BY src", "invests_in")
def investor_stats(t):
    return graph.investor_stats(t.invests_in())


@query("SELECT a.src AS a, b.src AS b, count(*) AS shared FROM invests_in a JOIN invests_in b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2", "invests_in")
def coinvestors(t):
    return graph.coinvestors(t.invests_in())


@query("SELECT a.src AS a, b.src AS b, count(*) AS shared FROM invests_in a JOIN invests_in b ON a.dst = b.dst AND a.src < b.src WHERE a.src = 's1' OR b.src = 's1' GROUP BY 1, 2 ORDER BY shared DESC, 1, 2 LIMIT 40", "invests_in")
def top_coinvestors(t):
    return gold.top(graph.coinvestors_of(t.invests_in(), "s1"), 40, F.desc("shared"), "a", "b")


@query("SELECT src AS investor, count(*) AS portfolio, array_to_string(list_sort(list(DISTINCT sector)), ', ') AS sectors FROM invests_in JOIN company ON company.id = dst GROUP BY src", "invests_in", "company")
def investor_leaderboard(t):
    return graph.investor_leaderboard(t.invests_in(), t.company())


@query("WITH d AS (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge WHERE src <> dst) SELECT id, count(*) AS degree FROM d GROUP BY id", "edge")
def degrees(t):
    return graph.degrees(t.edge())


@query("WITH n AS (SELECT dst AS id, rel, src AS other, 'in' AS direction FROM edge WHERE dst LIKE 'c%' UNION ALL SELECT src, rel, dst, 'out' FROM edge WHERE src LIKE 'c%') SELECT n.id, rel, other, direction, e.type AS other_type, e.canonical AS other_name FROM n JOIN entity e ON e.id = n.other", "edge", "entity")
def neighbors(t):
    return graph.neighbors(t.entity(), t.edge(), t.company())


@query("WITH n AS (SELECT dst AS id, rel, src AS other, 'in' AS direction FROM edge UNION ALL SELECT src, rel, dst, 'out' FROM edge) SELECT id, rel, direction, count(*) AS n, count(DISTINCT other) AS others FROM n JOIN entity v USING (id) WHERE v.type = 'company' GROUP BY 1, 2, 3", "edge", "entity")
def company_360(t):
    return graph.company_360(t.entity(), t.edge())


@query("WITH w AS (SELECT src, dst, CAST(start AS VARCHAR) AS start FROM works_at), a AS (SELECT src AS id, rel, src, dst FROM edge UNION ALL SELECT dst, rel, src, dst FROM edge WHERE src <> dst) SELECT id, rel, src, dst, start FROM a LEFT JOIN w USING (src, dst)", "edge", "works_at")
def entity_activity(t):
    return graph.entity_activity(t.edge(), dated(t.works_at(), "start").select("src", "dst", "start"))


@query("WITH h1 AS (SELECT src, 'works_at' AS rel, dst FROM works_at WHERE src = 'p1' OR dst = 'g2'), f AS (SELECT src AS id FROM h1 UNION SELECT dst FROM h1) SELECT DISTINCT src, 'works_at' AS rel, dst FROM works_at WHERE src IN (SELECT id FROM f) OR dst IN (SELECT id FROM f)", "works_at")
def subgraph_2hop(t):
    e = t.works_at().select("src", F.lit("works_at").alias("rel"), "dst")
    return graph.subgraph(e, t.entity().where("id IN ('p1', 'g2')"), 2)


@query("SELECT DISTINCT 'hub' AS src, 'sector' AS rel, sector AS dst FROM company WHERE sector IS NOT NULL UNION ALL SELECT sector, 'in_sector', id FROM company WHERE sector IS NOT NULL", "company")
def hub_layer(t):
    return graph.hub_layer(t.company())


@query("SELECT v.id, v.type, v.canonical, coalesce(d.degree, 0) AS degree FROM entity v LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY id) d USING (id)", "entity", "edge")
def export_graph(t):
    return graph.export_graph(t.entity(), t.edge())


@query("SELECT v.* FROM entity v WHERE type IN ('org', 'school', 'company') AND NOT EXISTS (SELECT 1 FROM edge WHERE rel <> 'involves' AND rel <> 'studied_at' AND (src = v.id OR dst = v.id))", "entity", "edge")
def orphan_nodes(t):
    """Nodes that no investment and no job touches: all schools, and some companies."""
    return graph.orphan_nodes(t.entity(), t.edge().where("rel NOT IN ('involves', 'studied_at')"), ["org", "school", "company"])


@query("SELECT e.* FROM edge e JOIN entity a ON a.id = e.src JOIN entity b ON b.id = e.dst WHERE a.type IN ('person', 'org') AND b.type IN ('person', 'org') AND rel IN ('works_at', 'studied_at')", "entity", "edge")
def filter_graph(t):
    return graph.filter_graph(t.entity(), t.edge(), ["person", "org"], ["works_at", "studied_at"]).select("src", "rel", "dst")


#: Intros to the second employer; the first is the home firm. The lists show the first fifteen paths, as the views do.
def intro_sql(ties: str, nodes: str) -> str:
    return (
        "WITH staff AS (SELECT DISTINCT src FROM works_at WHERE dst = 'g2'), own AS (SELECT DISTINCT src FROM works_at WHERE dst = 'g1') "
        f"SELECT DISTINCT c.src AS connector_id, pc.canonical AS connector, v.canonical AS via, b.src AS contact_id, pb.canonical AS contact, c.src IN (SELECT src FROM own) AS is_home "
        f"FROM {ties} b JOIN {ties} c ON c.dst = b.dst AND c.src <> b.src JOIN person pb ON pb.id = b.src JOIN person pc ON pc.id = c.src JOIN {nodes} v ON v.id = b.dst "
        "WHERE b.src IN (SELECT src FROM staff) AND b.dst <> 'g2' AND c.src NOT IN (SELECT src FROM staff) ORDER BY is_home DESC, connector, connector_id, via, contact_id LIMIT 15"
    )


def firm(t: Tables, ident: str) -> DataFrame:
    return t.employer().where(F.col("id") == ident).select("id")


@query(intro_sql("works_at", "employer"), "works_at", "person", "employer")
def intro_employer(t):
    w = checkpoints.cut(t.works_at())
    return graph.intro_paths(w, w, t.person(), t.employer(), firm(t, "g2"), firm(t, "g1"), 15)


@query(intro_sql("studied_at", "school"), "works_at", "studied_at", "person", "school")
def intro_school(t):
    return graph.intro_paths(t.studied_at(), checkpoints.cut(t.works_at()), t.person(), t.school(), firm(t, "g2"), firm(t, "g1"), 15)


@query("WITH n AS (SELECT src, count(*) AS portfolio FROM invests_in GROUP BY src) SELECT e.dst AS company_id, e.src AS investor_id, v.canonical AS investor, portfolio FROM invests_in e JOIN n USING (src) JOIN investor v ON v.id = e.src JOIN company c ON c.id = e.dst WHERE c.sector = 'BUILDING'", "invests_in", "investor", "company")
def intro_investor(t):
    """Who could introduce to the companies of a sector as an investor, with how much else they hold."""
    return graph.company_investors(t.invests_in(), t.investor(), t.company().where("sector = 'BUILDING'"))


@query("WITH r AS (SELECT c_name AS company, 'Customer#' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 9, '0') AS referrer FROM customer WHERE c_custkey % 3 > 0), p AS (SELECT canonical, min(id) AS id FROM person GROUP BY 1), own AS (SELECT DISTINCT src FROM works_at WHERE dst = 'g1') SELECT company, referrer, p.id AS person_id, coalesce(p.id IN (SELECT src FROM own), false) AS is_home FROM r LEFT JOIN p ON p.canonical = r.referrer", "person", "works_at")
def intro_referrer(t):
    k = F.col("c_custkey")
    referred = t.customer.select(F.col("c_name").alias("company"), F.when(k % 3 > 0, F.concat(F.lit(" CUSTOMER#"), F.lpad((k * 7 % 1000).cast("string"), 9, "0"))).otherwise(" ").alias("referrer"))
    return graph.referrer_paths(referred, t.person(), t.works_at(), firm(t, "g1")).withColumn("referrer", F.replace("referrer", F.lit("CUSTOMER"), F.lit("Customer")))


@query("SELECT src AS investor, 0 AS block, list(canonical ORDER BY canonical, company.id) AS companies FROM invests_in JOIN company ON company.id = dst GROUP BY src", "invests_in", "company")
def investor_companies(t):
    return graph.ordered_companies(t.invests_in(), t.company()).withColumn("block", F.col("block").cast("int"))


#: Employers as companies with websites shared by some, and the next one's name as an alias of every seventh.
SITES = "sites AS (SELECT 'g' || s_suppkey AS id, s_name AS canonical, CASE WHEN s_suppkey % 5 = 0 THEN 'f' || s_suppkey % 20 END AS website, s_suppkey AS k FROM supplier), al AS (SELECT a.id, b.canonical AS alias FROM sites a JOIN sites b ON b.k = a.k + 1 WHERE a.k % 7 = 0)"
GROUPED = f"{SITES}, ln AS (SELECT a.id AS a, b.id AS b FROM sites a JOIN sites b ON a.id <> b.id AND a.website = b.website UNION SELECT al.id, s.id FROM al JOIN sites s ON s.canonical = al.alias UNION SELECT s.id, al.id FROM al JOIN sites s ON s.canonical = al.alias), rc AS (SELECT id AS a, id AS b FROM sites UNION SELECT rc.a, ln.b FROM rc JOIN ln ON ln.a = rc.b), cl AS (SELECT a AS id, min(b) AS cluster FROM rc GROUP BY a)"


def grouped(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    sites = t.supplier.select(F.concat(F.lit("g"), k).alias("id"), F.col("s_name").alias("canonical"), F.when(k % 5 == 0, F.concat(F.lit("https://www.f"), k % 20, F.lit("/"))).alias("website"), k.alias("k"))
    aliases = sites.where("k % 7 = 0").select("id", (F.col("k") + 1).alias("k")).join(sites.select("k", F.upper("canonical").alias("alias")).hint("merge"), "k").select("id", "alias")
    return graph.company_groups(sites, aliases)


@query(f"WITH RECURSIVE {GROUPED} SELECT id, cluster FROM cl")
def company_groups(t):
    return grouped(t)


@query(f"WITH RECURSIVE {GROUPED} SELECT cluster, w.src AS id, min(p.canonical) AS canonical, bool_or(current) AS current, max(concat_ws(' – ', CAST(start AS VARCHAR), CAST(stop AS VARCHAR))) AS tenure FROM works_at w JOIN cl ON cl.id = w.dst JOIN person p ON p.id = w.src GROUP BY 1, 2", "works_at", "person")
def group_people(t):
    """People of every company with its duplicates, and their tenure."""
    return graph.group_people(t.works_at(), t.person(), grouped(t))


@query("WITH x AS (SELECT min(src) AS p FROM works_at) SELECT b.src AS person, count(*) AS shared, bool_or(a.current AND b.current) AS both_current FROM works_at a JOIN works_at b ON a.dst = b.dst AND b.src <> a.src WHERE a.src = 'p1' GROUP BY b.src", "works_at")
def colleagues(t):
    return graph.colleagues(t.works_at(), "p1")


@query("SELECT w.src AS id, bool_or(current) AS current, CAST(min(start) AS VARCHAR) AS start, min(canonical) AS canonical FROM works_at w JOIN person p ON p.id = w.src WHERE dst IN (SELECT id FROM employer WHERE type = 'company') GROUP BY 1", "works_at", "person", "employer")
def company_people(t):
    return dated(graph.company_people(t.works_at(), t.person(), t.employer().where("type = 'company'")), "start")


@query("SELECT id, count(*) FILTER (c) AS now, count(*) FILTER (NOT c) AS past FROM (SELECT dst AS id, src, bool_or(current) AS c FROM works_at GROUP BY 1, 2) GROUP BY id", "works_at")
def team_split(t):
    return graph.team_split(t.works_at())


@query("WITH w AS (SELECT src AS person, count(DISTINCT dst) FILTER (current) AS n_now, count(DISTINCT dst) FILTER (NOT current) AS n_past FROM works_at GROUP BY 1), s AS (SELECT src AS person, count(DISTINCT dst) AS n_schools FROM studied_at GROUP BY 1) SELECT person, coalesce(n_now, 0) AS n_now, coalesce(n_past, 0) AS n_past, coalesce(n_schools, 0) AS n_schools FROM w FULL JOIN s USING (person)", "works_at", "studied_at")
def affiliations(t):
    df = graph.affiliations(t.works_at(), t.studied_at())
    return df.select("person", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("now", "past", "schools")])


@query("SELECT dst AS id, count(DISTINCT src) AS members FROM studied_at GROUP BY dst", "studied_at")
def member_counts(t):
    return graph.member_counts(t.studied_at())


# Landing and upserts ------------------------------------------------------------------------------------------------
@query("SELECT source, source_id FROM raw_item GROUP BY source, source_id", "raw_item")
def land_dedup(t):
    one = t.raw_item().withColumn("seq", F.lit(1))
    return raw.land_raw(one.unionByName(one.withColumn("seq", F.lit(2)))).select("source", "source_id")


@query("SELECT event_type AS source, event_id AS source_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 10 <> 0")
def incremental_read(t):
    df = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("source_id"), F.col("ts").alias("at"))
    return raw.incremental(df, "2024-01-15", df.where("source_id % 10 = 0")).select("source", "source_id")


@query("SELECT source, source_id FROM raw_item r WHERE source <> 'src3'", "raw_item")
def orphan_raw(t):
    r = t.raw_item()
    return r.join(r.where("source = 'src3'").select("source", "source_id"), ["source", "source_id"], "left_anti").select("source", "source_id")


@query("SELECT 'company' AS type, c_name AS canonical, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE c_mktsegment END AS sector, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS note FROM customer")
def upsert_entities(t):
    base = t.customer.select(F.lit("company").alias("type"), F.col("c_name").alias("canonical"), F.create_map(F.lit("sector"), F.col("c_mktsegment")).alias("attrs"), F.lit(1).alias("seq"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.lit("company").alias("type"), F.col("c_name").alias("canonical"), F.create_map(F.lit("sector"), F.lit("X"), F.lit("note"), F.lit("new")).alias("attrs"), F.lit(2).alias("seq"))
    return upsert.upsert_entities(base, new).select("type", "canonical", F.try_element_at("attrs", F.lit("sector")).alias("sector"), F.try_element_at("attrs", F.lit("note")).alias("note"))


@query("SELECT src, rel, dst FROM edge UNION SELECT src, 'follows', dst FROM invests_in", "edge", "invests_in")
def upsert_edges(t):
    new = t.invests_in().select("src", F.lit("follows").alias("rel"), "dst", F.lit(None).cast("string").alias("envelope_id"))
    return upsert.upsert_edges(t.edge(), new.unionByName(t.edge())).select("src", "rel", "dst")


@query("SELECT id, entity_id, metric, CASE WHEN source = 'Registry' AND metric = 'revenue' THEN value_num + 1 ELSE value_num END AS value_num, source FROM observation", "observation")
def replace_observations(t):
    o = t.observation().select("id", "entity_id", "metric", "value_num", "source")
    return upsert.replace_observations(o, o.where("source = 'Registry' AND metric = 'revenue'").withColumn("value_num", F.col("value_num") + 1), "Registry")


@query("SELECT o_orderkey AS envelope_id, o_custkey FROM orders WHERE o_orderstatus <> 'P'")
def cascade_delete(t):
    o = t.orders.select(F.col("o_orderkey").alias("envelope_id"), "o_custkey", "o_orderstatus")
    return upsert.cascade_delete({"orders": o}, o.where("o_orderstatus = 'P'"))["orders"].select("envelope_id", "o_custkey")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'won' ELSE o_orderstatus END AS stage FROM orders")
def apply_actions(t):
    base = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stage"))
    acts = base.where("id % 3 = 0").select("id", F.lit("lost").alias("stage"), F.lit(1).alias("seq"))
    acts = acts.unionByName(acts.select("id", F.lit("won").alias("stage"), F.lit(2).alias("seq"))).unionByName(acts.select("id", F.lit("nonsense").alias("stage"), F.lit(3).alias("seq")))
    return upsert.apply_actions(base, acts, ["won", "lost"])


# Envelopes, gates, text ---------------------------------------------------------------------------------------------
@query("SELECT 'whatsapp' AS source, conv_id || '-' || turn AS source_id, sha256(CASE WHEN trim(text) = '' THEN conv_id || '-' || turn ELSE trim(text, ' ') END) AS content_hash FROM conversations")
def envelopes_chat(t):
    return normalize.normalize(t.raw_item().where("source = 'chat'")).select("source", "source_id", "content_hash")


@query("SELECT source, CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS content_hash, sha256(source || '|' || doc_id || '|' || sha256(text)) AS idempotency_key FROM documents")
def envelopes_docs(t):
    return normalize.map_document(t.documents).select("source", "source_id", "content_hash", "idempotency_key")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents")
def inherit_notes(t):
    items = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return dedup.inherit_notes(items).select(F.col("id").alias("doc_id"), "original")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(t):
    return t.pages.select("page_id", S.html_to_text("html").alias("text"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]+)', 1), '^www\.', '') AS domain FROM pages")
def page_domains(t):
    return t.pages.select("page_id", S.domain_of("url").alias("domain"))


@query("SELECT doc_id, least(1.0, 0.3 + CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(the|of)([^a-z]|$)') THEN 0.25 ELSE 0 END - CASE WHEN length(text) < 20 THEN 0.3 ELSE 0 END) >= 0.35 AS passed FROM documents")
def signal_gate(t):
    docs = t.documents.select("doc_id", "source", F.lit(None).cast("string").alias("title"), F.col("text").alias("body_clean"), F.array().cast("array<string>").alias("labels"))
    score = normalize.signal_score(normalize.R.Rules(deal_terms=("the", "of")))
    return normalize.apply_gate(docs.withColumn("signal_score", score)).select("doc_id", (F.col("status") == "normalized").alias("passed"))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'trusted_label' WHEN role = 'assistant' THEN 'automated' ELSE 'low_signal' END AS reason FROM conversations")
def mail_classes(t):
    h = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    mails = t.conversations.select("conv_id", "turn", F.when(F.col("turn") == 0, F.array(F.lit("L1"))).otherwise(F.array().cast("array<string>")).alias("label_ids"), F.array(h("From", F.when(F.col("role") == "assistant", "no-reply@example.com").otherwise("a@example.com")), h("Subject", F.lit("Re: hello"))).alias("headers"), F.lit("").alias("body"))
    return normalize.classify_mail(mails, normalize.R.Rules(trusted_labels=("L1",))).select("conv_id", "turn", "decision.reason")


@query("SELECT doc_id, 'k' || n AS id FROM documents, (SELECT unnest(['ther', 'tion', 'ing the']) AS w, unnest([0, 1, 2]) AS n) WHERE contains(lower(text), w)")
def resolve_mentions(t):
    spine = t.spark.createDataFrame([("k0", "ther"), ("k1", "Tion"), ("k2", "ing the")], "id string, canonical string")
    return normalize.mentions(t.documents, spine)


@query("SELECT o_orderkey AS doc_id, 'c' || o_custkey AS id FROM orders")
def many_mentions(t):
    """Each order's text names its customer, among all customers' names."""
    texts = t.orders.join(t.customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Met with "), F.upper("c_name"), F.lit(" about "), "o_orderpriority").alias("text"))
    return normalize.mentions(texts, t.company(), small=64)


@query("SELECT doc_id, length(text) AS n, length(text) // 4 AS token_est FROM documents")
def token_est(t):
    return t.documents.select("doc_id", F.length("text").alias("n"), S.token_est("text").alias("token_est"))


@query(
    "WITH RECURSIVE pr AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS a FROM documents WHERE text <> ''), "
    "pc AS (SELECT doc_id, a, p, unnest(range(greatest(1, CAST(ceil(length(p) / 1800.0) AS BIGINT)))) AS j FROM pr), "
    "pn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, j) AS i, substr(p, j * 1800 + 1, 1800) AS x, (j + 1) * 1800 < length(p) AS whole FROM pc), "
    "st AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, CAST(NULL AS BIGINT) AS n, 0::BIGINT AS c, CAST(NULL AS BIGINT) AS own FROM pn "
    "UNION ALL SELECT doc_id, i, CASE WHEN whole THEN NULL WHEN held THEN n + length(x) + 1 WHEN length(x) > 0 THEN length(x) END, CASE WHEN whole THEN c + 1 ELSE c END, CASE WHEN whole OR held OR length(x) > 0 THEN c END "
    "FROM (SELECT s.doc_id, p.i, x, whole, s.n, s.c + CASE WHEN s.n IS NOT NULL AND (whole OR s.n + length(x) > 1800) THEN 1 ELSE 0 END AS c, s.n IS NOT NULL AND NOT (whole OR s.n + length(x) > 1800) AS held FROM st s JOIN pn p ON p.doc_id = s.doc_id AND p.i = s.i + 1)), "
    "ch AS (SELECT st.doc_id, own, trim(string_agg(x, chr(10) ORDER BY st.i), ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM st JOIN pn USING (doc_id, i) WHERE own IS NOT NULL GROUP BY 1, 2) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY own) - 1 AS INTEGER) AS seq, chunk, length(chunk) // 4 AS token_est FROM ch"
)
def chunks(t):
    return text.chunk(t.documents.select("doc_id", "text"), sep="\n")


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10) || chr(10))[:120000] AS text FROM conversations GROUP BY conv_id")
def assemble_docs(t):
    return text.assemble(t.conversations.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("chunk")), "conv_id")


@query("SELECT conv_id, sum(length(trim(text, ' '))) / count(*) >= 200 AS has_text FROM conversations GROUP BY conv_id")
def text_layer(t):
    return text.has_text_layer(t.conversations, "conv_id", 200)


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 3) + 0.0::DOUBLE AS distance FROM embeddings, q) SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 3")
def knn(t):
    return search.knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3)


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 3) + 0.0::DOUBLE AS distance FROM embeddings, q) SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 8")
def knn_hundredths(t):
    """The whole search: every row whose id is divisible by 100 is a query."""
    return search.knn(t.embeddings, t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 8)


#: A vector's document is the envelope of its id; those of src3 are not indexed, every third has an attachment.
SEEN = "e AS (SELECT e.* FROM embeddings e JOIN documents ON doc_id = vec_id WHERE source <> 'src3')"


@query(f"WITH {SEEN}, q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 3) + 0.0::DOUBLE AS distance FROM e, q), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 8) "
       "SELECT query_id, vec_id, distance, rank, lang AS company, CASE WHEN vec_id % 3 = 0 THEN 'pdf' ELSE source END AS source, CASE WHEN vec_id % 3 = 0 THEN 'deck' ELSE source END AS kind, 'ref' || vec_id AS ref, lang || CASE WHEN vec_id % 3 = 0 THEN ' — Deck p.' || (vec_id % 9 + 1) ELSE ' — ' || source || ' paper ' || vec_id END AS cite FROM h JOIN documents ON doc_id = vec_id")
def retrieved(t):
    """The eight nearest indexed chunks of every hundredth vector, with where they come from."""
    third, ident = F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")
    d = t.documents
    chunks = d.select(F.col("doc_id").alias("vec_id"), F.col("doc_id").alias("envelope_id"), (F.col("doc_id") % 9 + 1).alias("page"), "text", F.when(third, F.concat(F.lit("ref"), ident)).alias("attachment_ref"))
    envelopes = d.select(F.col("doc_id").alias("envelope_id"), F.col("lang").alias("company"), F.concat(F.col("source"), F.lit("\npaper "), ident).alias("title"), F.when(third, "pdf").otherwise(F.col("source")).alias("source"), F.when(F.col("source") != "src3", "indexed").alias("status"), F.concat(F.lit("ref"), ident).alias("ref"))
    seen = t.embeddings.join(envelopes.where("status = 'indexed'").select(F.col("envelope_id").alias("vec_id")).hint("merge"), "vec_id", "left_semi")
    hits = search.knn(seen, t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 8)
    return search.retrieved(hits, chunks, envelopes).drop("title", "page", "text")


@query(
    "WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), m AS (SELECT label, list(v ORDER BY i) AS e FROM x GROUP BY label) "
    "SELECT a.label AS a, b.label AS b, floor((1 - list_cosine_similarity(a.e, b.e)) * 1000 + 0.5) / 1000 AS distance, row_number() OVER (PARTITION BY a.label ORDER BY floor((1 - list_cosine_similarity(a.e, b.e)) * 1000 + 0.5), b.label) AS rank FROM m a JOIN m b ON a.label <> b.label QUALIFY rank <= 3"
)
def comparables(t):
    return search.comparables(search.mean_vectors(t.embeddings, "label"), "label", 3)


# Scalars ------------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS DECIMAL(20, 4))::DOUBLE AS strict, CASE WHEN o_orderkey % 2 = 0 THEN round(floor(o_totalprice) * 8.5, 4) ELSE CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS lenient FROM orders")
def numbers(t):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("decimal(20,2)").cast("string")).otherwise(F.col("o_orderpriority"))
    money = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit("M"))).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", S.gb_num(mixed).cast("double").alias("strict"), S.safe_num(money).alias("lenient"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'machinery' THEN c_mktsegment ELSE c_mktsegment END AS sector, CASE c_custkey % 3 WHEN 0 THEN 'Fintech' WHEN 1 THEN 'SaaS' ELSE 'Rare Thing' END AS mapped FROM customer")
def canon_sector(t):
    key = F.element_at(F.array(F.lit(" Banking "), F.lit("SOFTWARE"), F.lit("Rare Thing")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.customer.select("c_custkey", S.canon_sector("c_mktsegment").alias("sector"), S.canon_sector(key).alias("mapped"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'vc' ELSE 'company' END AS kind FROM supplier")
def entity_types(t):
    summary = F.when(F.col("s_suppkey") % 2 == 0, "an early Venture Capital firm").otherwise("makes things")
    return t.supplier.select("s_suppkey", S.entity_type(F.lit(None).cast("string"), "s_name", summary).alias("kind"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS core FROM part")
def norm_names(t):
    return t.part.select("p_partkey", S.core_key(F.concat("p_name", F.lit(" Pvt. Ltd"))).alias("core"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s_.]+', '-', 'g') AS slug FROM part")
def slugs(t):
    return t.part.select("p_partkey", S.slug_id("p_name").alias("slug"))


@query("SELECT o_orderkey, ['Financials', 'Annual Return', 'Charge', 'Valuation', 'Other'][o_orderkey % 5 + 1] AS kind FROM orders")
def filing_kinds(t):
    names = F.array(F.lit("Form AOC-4 XBRL"), F.lit("MGT-7 filing"), F.lit("CHG-1"), F.lit("valuation report"), F.lit("KYC of directors"))
    return t.orders.select("o_orderkey", S.doc_kind(F.lit(None).cast("string"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("kind"))


@query("SELECT c_custkey, lower(c_name) || '@example.com' AS email, c_custkey % 2 = 0 AS internal FROM customer")
def emails(t):
    raw_ = F.concat(F.col("c_name"), F.lit(" <"), F.lower(F.regexp_replace("c_name", "#", "")), F.when(F.col("c_custkey") % 2 == 0, "@example.com").otherwise("@other.org"), F.lit(">"))
    plain = F.concat(F.lower("c_name"), F.lit("@example.com"))
    return t.customer.select("c_custkey", plain.alias("email"), S.is_internal_email(S.email_of(raw_), ["example.com"]).alias("internal"))


# Knowledge and identity ---------------------------------------------------------------------------------------------
def full_notes(t: Tables) -> DataFrame:
    n = t.note()
    return n.select("*", F.array(F.lit("Asha Rao"), F.lit("Founder")).alias("founders"), F.array(F.concat(F.lit("Fund "), (F.col("id") % 50).cast("string")), F.lit("HNIs")).alias("investors"), F.array(F.lit("call back"), F.lit(" ")).alias("action_items"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("confidence"))


@query("SELECT 'company' AS type, company_name AS canonical FROM note UNION SELECT 'person', 'Asha Rao' UNION SELECT 'investor', 'Fund ' || id % 50 FROM note UNION SELECT 'deal', company_name || ' — ' || coalesce(round_type, 'Round') FROM note WHERE round_type IS NOT NULL OR ask IS NOT NULL", "note")
def note_entities(t):
    return knowledge.fan_out_entities(full_notes(t))


@query("SELECT 'Asha Rao' AS src, 'works_at' AS rel, company_name AS dst FROM note UNION SELECT 'Fund ' || id % 50, 'invests_in', company_name FROM note UNION SELECT company_name || ' — ' || coalesce(round_type, 'Round'), 'involves', company_name FROM note WHERE round_type IS NOT NULL OR ask IS NOT NULL", "note")
def note_edges(t):
    return knowledge.fan_out_edges(full_notes(t))


@query("SELECT id AS envelope_id, 'funding_ask' AS metric, ask AS value_num, CASE WHEN id % 2 = 0 THEN 'High' ELSE 'Medium' END AS confidence FROM note WHERE ask IS NOT NULL", "note")
def note_observations(t):
    return knowledge.fan_out_observations(full_notes(t), {"ask": "funding_ask"}).select("envelope_id", "metric", "value_num", "confidence")


@query("SELECT id AS envelope_id, 'call back' AS description FROM note", "note")
def note_tasks(t):
    return knowledge.fan_out_tasks(full_notes(t)).select("envelope_id", "description")


@query("SELECT o_orderkey AS envelope_id, CASE WHEN o_custkey % 2 = 0 THEN 'p' || o_custkey ELSE sha256('person|c' || o_custkey || '@x.org') END AS person_id, o_custkey % 2 <> 0 AS is_new FROM orders")
def resolve_actors(t):
    actors = t.orders.select(F.col("o_orderkey").alias("envelope_id"), F.concat(F.lit("C"), "o_custkey", F.lit("@x.org")).alias("actor"))
    keys = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey", F.lit("@x.org")).alias("key"), F.concat(F.lit("p"), "c_custkey").alias("id"))
    return knowledge.resolve_actors(actors, keys).select("envelope_id", "person_id", "is_new")


@query("SELECT 'a@firm' || s_suppkey || '.com' AS sender, 'g' || s_suppkey AS company_id FROM supplier WHERE s_suppkey <> 3")
def resolve_domains(t):
    senders = t.supplier.select(F.concat(F.lit("a@firm"), "s_suppkey", F.lit(".com")).alias("sender"))
    companies = t.supplier.select(F.concat(F.lit("g"), "s_suppkey").alias("id"), F.concat(F.lit("https://www.firm"), "s_suppkey", F.lit(".com/about")).alias("website"))
    return knowledge.resolve_domains(senders, companies, ("firm3.com",))


@query("WITH c AS (SELECT 'k' || p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS core FROM part) SELECT id, min(id) OVER (PARTITION BY core) AS cluster, count(*) OVER (PARTITION BY core) AS size FROM c WHERE length(core) >= 3 QUALIFY size > 1")
def core_clusters(t):
    return dedup.core_clusters(t.part.select(F.concat(F.lit("k"), "p_partkey").alias("id"), F.lit("org").alias("type"), F.col("p_name").alias("canonical")))


@query("WITH c AS (SELECT page_id AS id, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/?#]+)', 1) AS web FROM pages) SELECT id, min(id) OVER (PARTITION BY web) AS cluster, count(*) OVER (PARTITION BY web) AS size FROM c WHERE web <> '' QUALIFY size > 1")
def web_clusters(t):
    """Pages of one site, its address written in several ways."""
    host, k = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.col("page_id") % 3
    site = F.when(k == 0, F.upper(host)).when(k == 1, F.concat(F.lit(" "), host, F.lit("//"))).otherwise(host)
    return dedup.web_clusters(t.pages.where(host != "").select(F.col("page_id").alias("id"), site.alias("website")))


@query("SELECT 'p' || c_custkey AS id, min('p' || c_custkey) OVER (PARTITION BY c_custkey // 5) AS cluster FROM customer QUALIFY count(*) OVER (PARTITION BY c_custkey // 5) > 1")
def components(t):
    c = t.customer
    pairs = c.where("c_custkey % 5 <> 4").select(F.concat(F.lit("p"), "c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("n")).join(c.select(F.col("c_custkey").alias("n")), "n").select("a", F.concat(F.lit("p"), "n").alias("b"))
    return dedup.components(pairs)


@query("SELECT 'p' || (c_custkey - 1) AS a, 'p' || c_custkey AS b, CASE WHEN (c_custkey // 2) % 3 = 0 THEN 'veto: phone' ELSE 'same email' END AS verdict FROM customer WHERE c_custkey % 2 = 1")
def person_verdicts(t):
    pair = F.floor(F.col("c_custkey") / 2)
    none = F.lit(None).cast("string")
    people = t.customer.select(F.format_string("%010d", "c_custkey").alias("id"), F.col("c_name").alias("name"), none.alias("slug"), F.concat(pair.cast("string"), F.lit("@x.org")).alias("email"), F.when(pair % 3 == 0, F.col("c_custkey").cast("string")).alias("phone"), none.alias("company"))
    plain = lambda c: F.concat(F.lit("p"), F.col(c).cast("long"))
    return dedup.person_pairs(people).select(plain("a").alias("a"), plain("b").alias("b"), "verdict")


#: People with few first names, slugs, addresses and employers, so that every rule and many conflicts occur.
PEOPLE = "SELECT 'p' || c_custkey AS id, concat_ws(' ', lower(c_mktsegment), CASE WHEN c_custkey % 3 > 0 THEN chr(CAST(97 + c_custkey % 17 AS INTEGER)) || 'ko' END) AS name, CASE WHEN c_custkey % 7 = 0 THEN 's' || c_custkey % 401 END AS slug, CASE WHEN c_custkey % 9 = 0 THEN 'e' || c_custkey % 331 END AS email, CASE WHEN c_custkey % 11 = 0 THEN 'q' || c_custkey % 97 END AS phone, list_filter(['n' || c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'm' || c_custkey % 53 END], lambda x: x IS NOT NULL) AS companies, list_filter([CASE WHEN c_custkey % 5 = 1 THEN 't' || c_custkey % 211 END], lambda x: x IS NOT NULL) AS threads, c_custkey % 6 AS degree FROM customer"
LINKS = (
    f"people AS ({PEOPLE}), pp AS (SELECT *, string_split(name, ' ') AS w FROM people), "
    "pairs AS (SELECT a.id AS a, b.id AS b, a AS x, b AS y, a.w = b.w AS equal, len(list_intersect(a.companies, b.companies)) > 0 AS co, len(list_intersect(a.threads, b.threads)) > 0 AS thr, CASE WHEN len(a.w) < len(b.w) THEN a ELSE b END AS short, CASE WHEN len(a.w) < len(b.w) THEN b ELSE a END AS long FROM pp a JOIN pp b ON a.id < b.id), "
    "judged AS (SELECT *, len(short.w) < len(long.w) AND long.w[1:len(short.w)] = short.w AS begins FROM pairs), "
    "links AS (SELECT a, b FROM judged WHERE NOT coalesce(x.slug <> y.slug, false) AND NOT coalesce(x.email <> y.email, false) AND NOT coalesce(x.phone <> y.phone, false) AND (coalesce(x.slug = y.slug, false) OR coalesce(x.email = y.email, false) OR (coalesce(x.phone = y.phone, false) AND (equal OR begins)) "
    "OR (begins AND short.slug IS NULL AND short.email IS NULL AND co AND (thr OR short.degree = 0)) OR (equal AND ((len(x.w) > 1 AND (co OR thr)) OR (co AND thr))))), "
    "reach AS (SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b)"
)


def people(t: Tables) -> DataFrame:
    k, text, some = F.col("c_custkey"), lambda p, n: F.concat(F.lit(p), F.col("c_custkey") % n), lambda *x: F.filter(F.array(*x), lambda v: v.isNotNull())
    name = F.concat_ws(" ", F.lower("c_mktsegment"), F.when(k % 3 > 0, F.concat(F.chr(97 + k % 17), F.lit("ko"))))
    return t.customer.select(
        F.concat(F.lit("p"), k).alias("id"), name.alias("name"), F.when(k % 7 == 0, text("s", 401)).alias("slug"), F.when(k % 9 == 0, text("e", 331)).alias("email"), F.when(k % 11 == 0, text("q", 97)).alias("phone"),
        some(F.concat(F.lit("n"), "c_nationkey"), F.when(k % 4 == 0, text("m", 53))).alias("companies"), some(F.when(k % 5 == 1, text("t", 211))).alias("threads"), (k % 6).alias("degree"),
    )


@query(f"WITH RECURSIVE {LINKS}, c AS (SELECT a AS id, least(a, min(b)) AS cluster FROM reach GROUP BY a) SELECT id, cluster FROM (SELECT c.*, count(DISTINCT slug) OVER (PARTITION BY cluster) AS n FROM c JOIN people USING (id)) WHERE n <= 1")
def person_clusters(t):
    return dedup.person_clusters(people(t))


JUDGED = (
    f"people AS ({PEOPLE}), pp AS (SELECT *, string_split(name, ' ') AS w, list_sort(companies) AS cs, list_sort(threads) AS ts FROM people), cls AS (SELECT *, min(id) OVER (PARTITION BY name, slug, email, phone, cs, ts, degree = 0) AS class FROM pp), "
    "pr AS (SELECT a.class AS a, b.class AS b, a AS x, b AS y, len(a.w) = len(b.w) AS same, len(list_intersect(a.companies, b.companies)) > 0 AS co, len(list_intersect(a.threads, b.threads)) > 0 AS thr, CASE WHEN len(a.w) < len(b.w) THEN a ELSE b END AS short FROM cls a JOIN cls b ON a.id < b.id AND a.w[1:least(len(a.w), len(b.w))] = b.w[1:least(len(a.w), len(b.w))]), "
    "jd AS (SELECT a, b, CASE WHEN x.slug <> y.slug THEN 'different slug' WHEN x.email <> y.email THEN 'different email' WHEN x.phone <> y.phone THEN 'different phone' WHEN x.slug = y.slug OR x.email = y.email OR x.phone = y.phone THEN NULL "
    "WHEN NOT same AND short.slug IS NULL AND short.email IS NULL AND co AND (thr OR short.degree = 0) THEN NULL WHEN same AND CASE WHEN len(x.w) > 1 THEN co OR thr ELSE co AND thr END THEN NULL WHEN same THEN 'same name but no shared company or thread' ELSE 'unverified (name only)' END AS reason FROM pr)"
)


@query(f"WITH {JUDGED} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS pairs, reason FROM jd WHERE reason IS NOT NULL GROUP BY ALL")
def kept_distinct(t):
    """Why people of one name, or of one that begins another's, are not merged."""
    return dedup.kept_distinct(people(t))


@query(f"WITH {JUDGED} SELECT id, class FROM cls")
def person_classes(t):
    return dedup.person_classes(people(t)).select("id", "class")


FIRMS = "SELECT 'k' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' Ltd' WHEN 1 THEN 'The ' || p_name || ' Ltd' WHEN 2 THEN p_name || ', Inc' ELSE p_name END AS canonical, CASE WHEN p_partkey % 100 = 0 THEN 'https://www.f' || p_partkey % 1000 || '.com/' END AS website, CASE WHEN p_partkey % 6 = 2 THEN [p_name || ' ltd'] ELSE [] END AS aliases FROM part"


def firms(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 4 == 0, F.concat(F.upper(n), F.lit(" Ltd"))).when(k % 4 == 1, F.concat(F.lit("The "), n, F.lit(" Ltd"))).when(k % 4 == 2, F.concat(n, F.lit(", Inc"))).otherwise(n)
    none = F.array().cast("array<string>")
    return t.part.select(F.concat(F.lit("k"), k).alias("id"), name.alias("canonical"), F.when(k % 100 == 0, F.concat(F.lit("https://www.f"), k % 1000, F.lit(".com/"))).alias("website"), F.when(k % 6 == 2, F.array(F.concat(n, F.lit(" ltd")))).otherwise(none).alias("aliases"))


@query(
    f"WITH RECURSIVE f AS ({FIRMS}), g AS (SELECT *, lower(canonical) AS low, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS core, [lower(x) FOR x IN aliases] AS al FROM f JOIN part ON id = 'k' || p_partkey), "
    "links AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND (a.website = b.website OR (a.core = b.core AND length(a.core) >= 4 AND (list_contains(b.al, a.low) OR contains(b.low, a.low))))), "
    "e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), m AS (SELECT a AS id, b FROM e UNION SELECT m.id, e.b FROM m JOIN e ON e.a = m.b) SELECT id, least(id, min(b)) AS cluster FROM m GROUP BY id"
)
def company_clusters(t):
    return dedup.company_clusters(firms(t))


GROUPS = "m AS (SELECT 'c' || c_custkey AS id, 'c' || (c_custkey - c_custkey % 3) AS k FROM customer WHERE c_custkey % 3 > 0 AND c_custkey - c_custkey % 3 > 0)"


def keepers(t: Tables) -> DataFrame:
    """Every third customer keeps the two after it."""
    k = F.col("c_custkey")
    return t.customer.where((k % 3 > 0) & (k > 2)).select(F.concat(F.lit("c"), k).alias("id"), F.concat(F.lit("c"), k - k % 3).alias("keeper"))


@query(f"WITH {GROUPS} SELECT o.id, coalesce(m.k, o.entity_id) AS entity_id, metric, value_num FROM observation o LEFT JOIN m ON m.id = o.entity_id", "observation")
def merged_observations(t):
    return dedup.move(t.observation(), keepers(t), "entity_id").select("id", "entity_id", "metric", "value_num")


@query(f"WITH {GROUPS} SELECT o.id, coalesce(m.k, o.company_id) AS company_id, status FROM task o LEFT JOIN m ON m.id = o.company_id", "task")
def merged_tasks(t):
    return dedup.move(t.task(), keepers(t), "company_id").select("id", "company_id", "status")


@query(
    f"WITH {GROUPS}, v AS (SELECT 'c' || c_custkey AS id, c_name, c_mktsegment AS sector, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS city, c_custkey FROM customer), "
    "r AS (SELECT v.*, coalesce(m.k, v.id) AS k, m.k IS NOT NULL AS loser FROM v LEFT JOIN m USING (id)) "
    "SELECT k AS id, max(c_name) FILTER (NOT loser) AS canonical, max(sector) FILTER (NOT loser) AS sector, min_by(city, id) FILTER (city IS NOT NULL) AS city, coalesce(string_agg(c_name, '|' ORDER BY id) FILTER (loser), '') AS aliases FROM r GROUP BY k"
)
def merged_entities(t):
    k = F.col("c_custkey")
    attrs = F.map_filter(F.create_map(F.lit("sector"), F.col("c_mktsegment"), F.lit("city"), F.when(k % 3 > 0, F.col("c_nationkey").cast("string"))), lambda _, v: v.isNotNull())
    v = t.customer.select(F.concat(F.lit("c"), k).alias("id"), F.col("c_name").alias("canonical"), attrs.alias("attrs"), F.array(F.upper("c_name")).alias("aliases"))
    # The keeper's own name in capitals is no alias of it; losers have none but their names.
    out = dedup.merge_entities(v.withColumn("aliases", F.when(F.substring("id", 2, 20).cast("long") % 3 == 0, F.col("aliases"))), keepers(t))
    return out.select("id", "canonical", F.try_element_at("attrs", F.lit("sector")).alias("sector"), F.try_element_at("attrs", F.lit("city")).alias("city"), F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {GROUPS} SELECT coalesce(m.k, p.id) AS id, coalesce(max(p.id) FILTER (m.k IS NULL), min(p.id)) AS taken_from FROM (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 6 > 0) p LEFT JOIN m USING (id) GROUP BY 1")
def merged_profiles(t):
    k = F.col("c_custkey")
    own = t.customer.where(k % 6 > 0).select(F.concat(F.lit("c"), k).alias("id"))
    return dedup.merge_profiles(own.withColumn("taken_from", F.col("id")), keepers(t))


@query(f"WITH {GROUPS} SELECT k AS keeper, id AS loser, 'same firm' AS reason FROM m")
def dedup_plan(t):
    return dedup.dedup_plan(keepers(t), "same firm")


MERGE = "c AS (SELECT s_suppkey, 'g' || s_suppkey AS id, s_suppkey // 4 AS cl FROM supplier), dg AS (SELECT dst AS id, count(*) AS degree FROM works_at GROUP BY dst), k AS (SELECT cl, id AS keeper FROM c LEFT JOIN dg USING (id) JOIN employer v USING (id) QUALIFY row_number() OVER (PARTITION BY cl ORDER BY coalesce(degree, 0) DESC, length(v.canonical), id) = 1)"


def survivors_of(t: Tables) -> DataFrame:
    c = t.supplier.select(F.concat(F.lit("g"), "s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 4).alias("cluster"))
    return dedup.pick_survivor(c, graph.degrees(t.works_at()), t.employer())


@query(f"WITH {MERGE} SELECT c.id, keeper FROM c JOIN k USING (cl)", "works_at", "employer")
def survivors(t):
    return survivors_of(t)


KEEPS = "cm AS (SELECT 'p' || c_custkey AS id, c_custkey // 4 AS cl, concat_ws(' ', c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Jr' END) AS name, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS profile FROM customer), dg AS (SELECT src AS id, count(*) AS degree FROM works_at GROUP BY src), al AS (SELECT cm.*, coalesce(degree, 0) AS degree FROM cm LEFT JOIN dg USING (id))"
ORDERS = {"company": "degree DESC, profile DESC", "person": "profile DESC, len(string_split(name, ' ')) DESC, degree DESC", "core": "length(name), degree DESC"}


@query(f"WITH {KEEPS}, k AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, cl, first_value(id) OVER (PARTITION BY cl ORDER BY {o}, id) AS keeper, id FROM al" for p, o in ORDERS.items()) + ") SELECT policy, id, keeper FROM k", "works_at")
def survivor_policies(t):
    """Who stays of clusters of four people, by each of the other policies."""
    k, work = F.col("c_custkey"), checkpoints.cut(t.works_at().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
    rows = t.customer.select(F.concat(F.lit("p"), k).alias("id"), F.floor(k / 4).alias("cluster"), F.concat_ws(" ", "c_name", F.when(k % 3 == 0, "Jr")).alias("canonical"), (k % 5 == 0).alias("has"))
    own = lambda p: dedup.pick_survivor(rows.select("id", "cluster"), work, rows, p, rows.where("has")).select(F.lit(p).alias("policy"), "id", "keeper")
    return own("company").unionByName(own("person")).unionByName(own("core"))


@query(f"WITH {MERGE} SELECT DISTINCT w.src, 'works_at' AS rel, keeper AS dst FROM works_at w JOIN c ON c.id = w.dst JOIN k USING (cl)", "works_at", "employer")
def merged_edges(t):
    return dedup.repoint(t.works_at().select("src", F.lit("works_at").alias("rel"), "dst", F.lit(None).cast("string").alias("envelope_id")), survivors_of(t)).select("src", "rel", "dst")


@query("SELECT p_partkey AS id, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN p_name || '-' || p_partkey ELSE p_name END AS unique_name FROM part")
def unique_names(t):
    return gold.unique_names(t.part, "p_name", "p_partkey").select(F.col("p_partkey").alias("id"), "unique_name")


@query("SELECT o_orderkey AS id FROM orders WHERE TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) >= 1998")
def filings_since(t):
    return raw.filings_since(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("filing_date")), 1998).select("id")
