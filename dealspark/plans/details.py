"""Registered queries of boards, actions, deletes, attributes, exports and operations, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import checkpoints, dedup, gold, graph, knowledge, normalize, profiles, text, upsert, views
from ..sources import raw
from ..streaming import streams
from .derived import Tables
from .flows import drained, stream_of
from .profiles import ABOUT, FILED, filed, obj, parsed_people
from .registry import CARD, LATEST, card, query

# Boards and actions -------------------------------------------------------------------------------------------------
PLACED = "pl AS (SELECT 'c' || c_custkey AS entity_id, CASE c_custkey % 6 WHEN 0 THEN 'Pitched' WHEN 1 THEN 'Won' END AS pipeline_stage, CASE WHEN c_custkey % 4 = 0 THEN 'clerk ' || c_nationkey END AS deal_owner FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 6 = 1)"


@query(f"WITH {LATEST}, {PLACED} SELECT card.entity_id, company_name, coalesce(pipeline_stage, 'Sourced') AS stage, deal_owner AS owner, has_deal FROM card LEFT JOIN pl USING (entity_id) WHERE has_deal OR pipeline_stage IS NOT NULL", *CARD)
def placed_pipeline(t):
    k = F.col("c_custkey")
    placed = t.customer.where((k % 2 == 0) | (k % 6 == 1)).select(F.concat(F.lit("c"), k).alias("entity_id"), F.when(k % 6 == 0, "Pitched").when(k % 6 == 1, "Won").alias("pipeline_stage"), F.when(k % 4 == 0, F.concat(F.lit("clerk "), "c_nationkey")).alias("deal_owner"))
    return gold.placed_pipeline(card(t), placed).drop("ask")


def actions(t: Tables) -> DataFrame:
    """Three actions on each third customer, the last of them void, and one that closes every fifth order's task."""
    k = F.col("c_custkey")
    each = F.array(obj(what="stage", value="Pitched", seq=1), obj(what="stage", value=F.when(k % 2 == 0, "Won").otherwise("Lost"), seq=2), obj(what="stage", value="Nonsense", seq=3), obj(what="owner", value=F.concat(F.lit("clerk "), "c_nationkey"), seq=4), obj(what="like", value="x", seq=5))
    own = t.customer.where(k % 3 == 0).select(F.concat(F.lit("c"), k).alias("target"), F.explode(each).alias("a")).select("target", "a.*")
    return own.unionByName(t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("target"), F.lit("done").alias("what"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("seq")))


def acted(t: Tables) -> tuple[DataFrame, DataFrame]:
    companies = t.company().select("id", F.lit("Sourced").alias("pipeline_stage"), F.lit(None).cast("string").alias("deal_owner"))
    return upsert.apply_updates(companies, t.task().select("id", "status"), actions(t), ["Sourced", "Pitched", "Won", "Lost"])


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'Sourced' WHEN c_custkey % 2 = 0 THEN 'Won' ELSE 'Lost' END AS pipeline_stage, CASE WHEN c_custkey % 3 = 0 THEN 'clerk ' || c_nationkey END AS deal_owner FROM customer")
def acted_companies(t):
    return acted(t)[0]


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'done' ELSE status END AS status FROM task", "task")
def acted_tasks(t):
    return acted(t)[1]


# Deletes ------------------------------------------------------------------------------------------------------------
#: Documents as envelopes, every third a PDF; four are their children or tables beside them; every seventh is to go.
def stored_documents(t: Tables) -> dict[str, DataFrame]:
    d, ident = t.documents, F.col("doc_id")
    child = lambda n: d.where(ident % n == 0).select(ident.alias("envelope_id"), F.lit(n).alias("n"))
    source = F.when(ident % 3 == 0, "pdf").otherwise("gmail")
    return {
        "envelope": d.select(ident.alias("id"), source.alias("source"), (ident + 1_000_000).alias("raw_id")), "raw": d.select((ident + 1_000_000).alias("id"), F.concat(F.lit("raw/"), ident).alias("storage_ref")),
        "attachment": d.where(ident % 2 == 0).select(ident.alias("envelope_id"), F.concat(F.lit("pdf/"), ident % 50).alias("storage_ref")), "chunk": child(1), "observation": child(2), "edge": child(5), "entity": d.select("lang").distinct(),
    }


def deleted(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    wanted = t.documents.where("doc_id % 7 = 0").select(F.explode(F.array(F.col("doc_id"), F.col("doc_id"), -F.col("doc_id") - 1)).alias("envelope_id"))
    return upsert.delete_documents(stored_documents(t), wanted)


@query(
    "WITH d AS (SELECT doc_id, doc_id % 7 = 0 AND doc_id % 3 = 0 AS gone FROM documents) SELECT what, CAST(n AS BIGINT) AS n FROM (SELECT 'envelope' AS what, count_if(NOT gone) AS n FROM d UNION ALL SELECT 'raw', count_if(NOT gone) FROM d UNION ALL SELECT 'attachment', count_if(NOT gone AND doc_id % 2 = 0) FROM d "
    "UNION ALL SELECT 'chunk', count_if(NOT gone) FROM d UNION ALL SELECT 'observation', count_if(NOT gone AND doc_id % 2 = 0) FROM d UNION ALL SELECT 'edge', count_if(NOT gone AND doc_id % 5 = 0) FROM d UNION ALL SELECT 'entity', (SELECT count(DISTINCT lang) FROM documents))"
)
def kept_rows(t):
    """What is left of each table after the delete."""
    out = None
    for name, df in deleted(t)[0].items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id AS envelope_id, doc_id % 3 = 0 AS removed, CASE WHEN doc_id % 3 > 0 THEN 'not of source pdf' END AS reason, CASE WHEN doc_id % 3 > 0 THEN '' WHEN doc_id % 2 = 0 THEN 'pdf/' || doc_id % 50 || '|raw/' || doc_id ELSE 'raw/' || doc_id END AS refs FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT -doc_id - 1, false, 'not found', '' FROM documents WHERE doc_id % 7 = 0")
def delete_report(t):
    return deleted(t)[1].withColumn("refs", F.array_join("refs", "|"))


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS industry FROM supplier")
def known_profiles(t):
    """Updates of profiles count only for entities that are known."""
    base = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("old").alias("industry"), F.lit(1).alias("seq"))
    new = base.where("substring(id, 2)::bigint % 4 = 0").unionByName(base.select(F.concat(F.lit("unknown "), "id").alias("id"), "industry", "seq")).withColumns({"industry": F.lit("new"), "seq": F.lit(2)})
    return upsert.upsert_known(base, new, t.investor(), "id", "seq").select("id", "industry")


# Attributes and senders ---------------------------------------------------------------------------------------------
def described(t: Tables) -> DataFrame:
    """Notes with a field that is null at times, two founders of which one is a role, and an unnamed contact."""
    n, k = t.note(), F.col("id")
    person = "array<struct<name:string,role:string,linkedin:string>>"
    founders = F.array(obj(name=F.concat_ws(" ", F.lit("Asha"), F.translate(F.regexp_replace("company_name", "[^0-9]", ""), "0123456789", "abcdefghij")), role=F.when(k % 2 == 0, F.concat(F.lit("role "), k % 4)), linkedin=None), obj(name="CEO", role="CEO", linkedin=None)).cast(person)
    return n.select("*", F.when(k % 3 == 0, F.concat(F.lit("city "), k % 5)).alias("hq"), founders.alias("founders"), F.array(obj(name=" ", role=None, linkedin=None)).cast(person).alias("key_people"))


@query(
    "WITH b AS (SELECT *, 'Asha ' || translate(regexp_replace(company_name, '[^0-9]', '', 'g'), '0123456789', 'abcdefghij') AS person FROM note) "
    "SELECT 'company' AS type, company_name AS canonical, concat_ws('|', 'hq=' || max_by(CASE WHEN id % 3 = 0 THEN 'city ' || id % 5 END, (occurred_at, id)) FILTER (id % 3 = 0), 'sector=' || max_by(sector, (occurred_at, id))) AS attrs FROM b GROUP BY 2 "
    "UNION ALL SELECT 'person', person, concat_ws('|', 'company=' || max_by(company_name, (occurred_at, id)), 'relation=founder', 'role=' || max_by('role ' || id % 4, (occurred_at, id)) FILTER (id % 2 = 0)) FROM b GROUP BY 2 "
    "UNION ALL SELECT 'deal', company_name || ' — ' || coalesce(round_type, 'Round'), concat_ws('|', 'company=' || min(company_name), 'round_type=' || max(round_type), 'status=active') FROM b WHERE round_type IS NOT NULL OR ask IS NOT NULL GROUP BY 2",
    "note",
)
def note_attributes(t):
    df = knowledge.fan_out_attributes(described(t))
    shown = F.array_join(F.transform(F.filter(F.map_entries("attrs"), lambda e: e["key"] != "ask"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return df.select("type", "canonical", shown.alias("attrs"))


@query("SELECT 'p' || o_custkey AS src, 'works_at' AS rel, 'g' || min(s_suppkey) AS dst FROM (SELECT DISTINCT o_custkey, o_custkey % 10 AS k FROM orders) JOIN supplier ON s_suppkey % 10 = k WHERE k <> 3 GROUP BY 1, k")
def sender_edges(t):
    """Senders work at the least supplier of their domain; one domain is generic, and some senders are numbers."""
    k = F.col("o_custkey")
    mails = t.orders.select(F.concat(F.lit("p"), k).alias("person_id"), F.concat(F.lit("A@FIRM"), k % 10, F.lit(".com")).alias("actor"))
    phones = mails.select("person_id", F.lit("+1555").alias("actor"))
    companies = t.supplier.select(F.concat(F.lit("g"), F.lpad("s_suppkey", 9, "0")).alias("id"), F.concat(F.lit("https://www.firm"), F.col("s_suppkey") % 10, F.lit(".com/x")).alias("website"))
    return knowledge.sender_edges(mails.unionByName(phones), companies, ("firm3.com",)).withColumn("dst", F.concat(F.lit("g"), F.substring("dst", 2, 9).cast("long")))


@query("SELECT c_custkey AS actor, CASE c_custkey % 3 WHEN 0 THEN 'Asha Rao' WHEN 1 THEN 'Ravi Sen' ELSE '+' || c_custkey END AS canonical FROM customer")
def named_senders(t):
    k = F.col("c_custkey")
    actors = t.customer.select(F.when(k % 3 == 2, F.concat(F.lit("+"), k)).otherwise(F.concat(F.lit("ravi_sen@x"), k, F.lit(".org"))).alias("actor"), F.when(k % 3 == 0, "Asha Rao").when(k % 3 == 1, "Team").otherwise(" ").alias("display"))
    return knowledge.named_senders(actors).withColumn("actor", F.regexp_extract("actor", "([0-9]+)", 1).cast("long"))


# Lists and exports --------------------------------------------------------------------------------------------------
@query(f"WITH {FILED}, {ABOUT} SELECT company_id, CAST(row_number() OVER w AS INTEGER) AS n, kind, filing_id, greatest(count(*) OVER (PARTITION BY company_id) - 4, 0) AS more FROM ab WINDOW w AS (PARTITION BY company_id ORDER BY filing_date DESC, filing_id) QUALIFY row_number() OVER w <= 4")
def note_filings(t):
    return views.note_filings(filed(t), 4).select("company_id", "n", "kind", "filing_id", "more")


@query(
    f"WITH {LATEST} SELECT 'companies' AS what, company_name AS name, CASE sector WHEN 'MACHINERY' THEN 'MACHINERY' ELSE sector END AS label FROM card UNION ALL SELECT 'deals', company_name, sector FROM card WHERE has_deal UNION ALL SELECT 'pipeline', company_name, sector FROM card WHERE NOT has_deal "
    "UNION ALL SELECT 'people', canonical, id FROM (SELECT canonical, id FROM person) UNION ALL SELECT 'log', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN 'Deck' ELSE 'Call' END FROM documents",
    *CARD, "person",
)
def index_exports(t):
    """All five exports, one below the other."""
    people = t.person().select("canonical", F.col("id").alias("role"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("linkedin"))
    log = t.documents.select(F.col("doc_id").alias("file"), F.lit("2024-01-01").alias("date"), F.col("lang").alias("company"), F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("gmail").alias("source"))
    out, show = None, {"people": ("name", "role"), "log": ("file", "meeting_type")}
    for what, df in views.index_exports(card(t), people, log).items():
        name, label = show.get(what, ("company_name", None))
        one = df.select(F.lit(what).alias("what"), F.col(name).cast("string").alias("name"), (F.col(label) if label else F.array_join("sectors", ",")).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


# What names each type of firm.
FIRMS = ("Venture debt desk", "A private equity house", "Blue asset management", "A micro-VC fund", "Law offices", "Advisory boutique", "makes things")
CATEGORIES = ("Venture Debt", "Private Equity", "Asset Management", "Venture Capital", "Law Firm", "Investment Banking", None)


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'Deck' WHEN doc_id % 8 < 4 THEN 'VC' ELSE 'Founder' END AS label, {[*CATEGORIES[:6], '', '']}[doc_id % 8 + 1] AS category FROM documents")
def meeting_records(t):
    """Documents name one of eight companies, seven of them of a type each and one that no one knows."""
    kind = F.element_at(F.array(*[F.lit(x) for x in FIRMS]), (F.col("k") + 1).cast("int"))
    companies = t.spark.range(7).withColumnRenamed("id", "k").select(F.concat(F.lit("Firm "), "k").alias("canonical"), F.lit(None).cast("string").alias("sector"), kind.alias("summary"))
    envelopes = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("FIRM "), F.col("doc_id") % 8).alias("company_name"), F.when(F.col("doc_id") % 5 == 0, "deck").otherwise("email").alias("kind"))
    return views.records(envelopes, companies).select("id", "label", F.coalesce("category", F.lit("")).alias("category"))


@query("SELECT 'p' || c_custkey AS id, c_name AS entity_name, CASE WHEN c_custkey % 2 = 0 THEN 'Asha Rao' ELSE 'Customer ' || split_part(c_name, '#', 2) END AS name FROM customer")
def person_full(t):
    return profiles.full_profile(t.entity(), parsed_people(t), "person").select("id", "entity_name", "name")


@query("SELECT 'c' || c_custkey AS id, c_name AS entity_name, CAST(1900 + c_custkey % 100 AS VARCHAR) AS founded FROM customer WHERE c_custkey % 3 > 0")
def company_full(t):
    k = F.col("c_custkey")
    rec = F.to_json(obj(name=F.col("c_name"), foundedOn=obj(year=1900 + k % 100)))
    made = profiles.parse_company_profile(t.customer.where(k % 3 > 0).select(F.concat(F.lit("c"), k).alias("id"), rec.alias("json")), "id")
    stray = made.withColumn("id", F.concat(F.lit("s"), F.substring("id", 2, 20)))  # of investors, not of companies
    return profiles.full_profile(t.entity(), made.unionByName(stray), "company").select("id", "entity_name", "founded")


@query(f"WITH {LATEST} SELECT company_name FROM card ORDER BY ask NULLS FIRST, company_name LIMIT 60", *CARD)
def sorted_companies(t):
    return gold.sort_companies(card(t), "ask").limit(60).select("company_name")


@query(f"WITH {LATEST} SELECT company_name FROM card ORDER BY last_interaction DESC NULLS LAST, company_name LIMIT 60", *CARD)
def recent_companies(t):
    return gold.list_companies(card(t)).limit(60).select("company_name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 11 > 0 ORDER BY c_custkey % 3 = 0 DESC, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 > 0 THEN c_custkey % 100 END DESC NULLS LAST, c_name, c_custkey LIMIT 60")
def listed_people(t):
    """People with a profile first, then by followers; stand-ins such as 'The Team' are left out."""
    k = F.col("c_custkey")
    cards = t.customer.select(k.alias("id"), F.when(k % 11 == 0, "The Team").otherwise(F.col("c_name")).alias("person"), (k % 3 == 0).alias("has_profile"), F.when((k % 3 == 0) & (k % 4 > 0), k % 100).alias("followers"))
    return views.list_people(cards).limit(60).select("id")


@query("SELECT 'p' || c_custkey AS person, list_sort(list_filter(['a' || c_custkey % 5, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey % 7 END], lambda x: x IS NOT NULL)) AS now, CASE WHEN c_custkey % 2 = 0 THEN [] ELSE ['c' || c_custkey % 7] END || ['o' || c_custkey % 3] AS past, ['n' || c_nationkey] AS schools FROM customer")
def affiliation_lists(t):
    """An unknown flag counts as current at companies (c), as past at other organisations (o); current wins (a)."""
    k = F.col("c_custkey")
    jobs = F.array(obj(dst=F.concat(F.lit("a"), k % 5), current=F.lit(True)), obj(dst=F.concat(F.lit("a"), k % 5), current=F.lit(False)), obj(dst=F.concat(F.lit("c"), k % 7), current=F.when(k % 2 > 0, F.lit(False))), obj(dst=F.concat(F.lit("o"), k % 3), current=F.lit(None).cast("boolean")))
    works = t.customer.select(F.concat(F.lit("p"), k).alias("src"), F.explode(jobs).alias("j")).select("src", "j.*")
    out = graph.affiliations(works, t.studied_at(), t.spark.range(7).select(F.concat(F.lit("c"), "id").alias("id")))
    return out.select("person", *[F.array_sort(c).alias(c) for c in ("now", "past", "schools")])


@query("SELECT company_name AS person, CASE WHEN right(company_name, 1) IN ('0', '5') THEN min_by(sector || id % 3, (occurred_at, id)) ELSE max_by(sector || id % 3, (occurred_at, id)) END AS company FROM note GROUP BY company_name", "note")
def internal_people(t):
    """Colleagues keep the company of their first mention."""
    m = t.note().select(F.col("company_name").alias("person"), F.lit(None).cast("string").alias("role"), F.concat("sector", (F.col("id") % 3).cast("string")).alias("company"), F.col("occurred_at").alias("at"), "id")
    return gold.merge_people(m, t.customer.where("right(c_name, 1) IN ('0', '5')").select(F.col("c_name").alias("person"))).select("person", "company")


# Operations ---------------------------------------------------------------------------------------------------------
@query("SELECT CAST(DATE '2023-11-14' + CAST(conv_id % 5 AS INTEGER) AS VARCHAR) AS day, role AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(turn) AS BIGINT) AS tokens_out, CAST(sum(CAST(length(text) % 97 AS DECIMAL(12, 4))) AS DOUBLE) AS usd FROM conversations GROUP BY 1, 2")
def spend_by_model(t):
    df = t.conversations.select(F.date_add(F.lit("2023-11-14").cast("date"), (F.col("conv_id") % 5).cast("int")).alias("at"), F.col("role").alias("model"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), (F.length("text") % 97).cast("decimal(12,4)").alias("usd"))
    return gold.spend_by_model(df).withColumns({"day": F.col("day").cast("string"), "usd": F.col("usd").cast("double")})


OPS = "lg AS (SELECT source, md5(text) AS h, CASE doc_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'raw' WHEN 2 THEN 'embedded' ELSE 'indexed' END AS status, doc_id % 20 AS d FROM documents)"


@query(f"WITH {OPS} SELECT source, count(*) AS n, round(count(*) FILTER (status = 'skipped') / count(*), 4) AS skip_rate, true AS collisions_close, CAST(31 - max(d) AS INTEGER) AS age_days, count(*) FILTER (status IN ('raw', 'embedded')) AS queued, CAST(sum(d) AS DOUBLE) AS usd FROM lg GROUP BY source")
def ops_figures(t):
    """All five figures from sketches of source and day; the estimated collision rate is held against the exact one, within
    four standard errors of the distinct count."""
    k = F.col("doc_id") % 5
    status = F.when(k == 0, "skipped").when(k == 1, "raw").when(k == 2, "embedded").otherwise("indexed")
    log = t.documents.select("source", status.alias("status"), F.md5("text").alias("content_hash"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 20).cast("int")).alias("at"), (F.col("doc_id") % 20).cast("decimal(12,2)").alias("usd"))
    exact = log.groupBy("source", "content_hash").agg(F.count("*").alias("_n")).groupBy("source").agg((1 - F.count("*") / F.sum("_n")).alias("_exact"))
    got = gold.ops_figures(gold.ops_sketches(log), "2024-02-01").join(exact.hint("merge"), "source")
    close = F.abs(F.col("collision_rate") - F.greatest(F.col("_exact"), F.lit(0.0))) <= 4 * 1.04 / 64
    return got.select("source", "n", "skip_rate", close.alias("collisions_close"), "age_days", "queued", F.col("usd").cast("double").alias("usd"))


@query("SELECT ['company', 'document', 'skipped', 'company'][event_id % 4 + 1] AS kind, count(*) AS n FROM events GROUP BY 1")
def loaded_kinds(t):
    """JSON lines of several kinds: companies (also those that don't say), documents, and what no one wants."""
    kind = F.element_at(F.array(F.lit("Company"), F.lit("document"), F.lit("gossip"), F.lit(" ")), (F.col("event_id") % 4 + 1).cast("int"))
    good, _ = raw.read_jsonl(t.events.select(F.to_json(obj(id=F.col("event_id"), kind=kind)).alias("value")), "id bigint, kind string")
    out = None
    for name, df in raw.by_kind(good).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'p' || c_custkey AS id, 'Asha Rao' AS name, c_custkey AS followers FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_suppkey FROM supplier")
def imported_profiles(t):
    """Profiles written as JSON files, of people and of companies, read back as a folder and parsed."""
    home = checkpoints.folder(t.spark)
    t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("publicIdentifier"), F.lit("Asha").alias("firstName"), F.lit("Rao").alias("lastName"), F.col("c_custkey").alias("followerCount")).write.json(f"{home}/people")
    t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("universalName"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("followerCount")).write.json(f"{home}/firms")
    items = lambda path, key: raw.read_profile_texts(t.spark, f"{home}/{path}", lines=True).select(F.get_json_object("json", f"$.{key}").alias("id"), "json")
    people = profiles.parse_profile(items("people", "publicIdentifier"), "id").select("id", "name", "followers")
    return people.unionByName(profiles.parse_company_profile(items("firms", "universalName"), "id").select("id", "name", F.col("followers").cast("long")))


# Rules that the flows use, on rows that reach their branches ---------------------------------------------------------
@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1700000000 + doc_id WHEN 1 THEN 1704164645 END AS stamp, doc_id % 4 < 2 AS known, CASE doc_id % 3 WHEN 0 THEN 'Fintech' WHEN 1 THEN 'SaaS' ELSE 'Mining' END AS sector, doc_id % 4 > 0 AS company, '₹' || CASE doc_id % 3 WHEN 0 THEN '12.5' WHEN 1 THEN '40' ELSE '0.07' END || ' Cr' AS money, CASE doc_id % 3 WHEN 0 THEN lang || ' — Deck p.' || doc_id WHEN 1 THEN lang || ' — Email' ELSE 'Deck' END AS cite FROM documents")
def value_details(t):
    k, third = F.col("doc_id") % 4, F.col("doc_id") % 3
    stamp = F.when(k == 0, (F.lit(1_700_000_000) + F.col("doc_id")).cast("string")).when(k == 1, "2024-01-02T03:04:05Z").when(k == 2, "soon")
    pick = lambda *xs: F.when(third == 0, xs[0]).when(third == 1, xs[1]).otherwise(xs[2])
    at: Column = F.unix_timestamp(S.parse_ts(stamp))
    return t.documents.select(
        "doc_id", at.alias("stamp"), at.isNotNull().alias("known"), S.primary_sector(pick("banking > Lending", " Software>Tools", "Mining > Iron")).alias("sector"), S.is_company_name(F.when(k == 0, F.when(F.col("doc_id") % 8 == 0, "TBD").otherwise("ab")).otherwise(F.concat(F.lit("firm "), "doc_id"))).alias("company"),
        S.fmt_cr(pick(F.lit(12.5), F.lit(40.0), F.lit(0.07))).alias("money"), S.cite(F.when(third < 2, F.col("lang")), pick(F.lit("deck"), F.lit("email"), F.lit("deck")), F.when(third == 0, F.col("doc_id"))).alias("cite"),
    )


SCORES = "pr AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 7 = 0 AS noise, doc_id % 5 = 0 AS known, doc_id % 4 = 0 AS att, doc_id % 3 = 0 AS deal, doc_id % 2 = 0 AS long, doc_id % 11 = 0 AS notes, doc_id % 13 = 0 AS ext FROM documents), sc AS (SELECT *, [0.6, 0.9, 0.7, 0.5, 0.4, 0.3][k + 1] - CASE WHEN k = 0 AND NOT ext THEN 0.4 ELSE 0 END + CASE WHEN known THEN 0.2 ELSE 0 END + CASE WHEN deal THEN 0.25 ELSE 0 END + CASE WHEN att THEN 0.2 ELSE 0 END - CASE WHEN noise THEN 0.4 ELSE 0 END - CASE WHEN NOT long AND NOT att THEN 0.3 ELSE 0 END AS s FROM pr)"


@query(f"WITH {SCORES} SELECT doc_id, CAST(round(greatest(0, least(1, CASE WHEN notes THEN greatest(s, 0.95) ELSE s END)), 4) AS DOUBLE) AS score, greatest(0, least(1, CASE WHEN notes THEN greatest(s, 0.95) ELSE s END)) >= 0.35 AS passed FROM sc")
def signal_scores(t):
    """The gate's score on rows that reach each of its terms."""
    k = F.col("doc_id")
    sources = F.array(*[F.lit(x) for x in ("calendar", "dashboard", "pdf", "drive_doc", "whatsapp", "other")])
    labels = F.filter(F.array(F.when(k % 7 == 0, "newsletter"), F.when(k % 11 == 0, "call-notes"), F.when(k % 13 == 0, "external-meeting")), lambda x: x.isNotNull())
    body = F.concat(F.when(k % 3 == 0, "zzdeal").otherwise("nothing"), F.when(k % 2 == 0, " and more words than twenty").otherwise(""))
    df = t.documents.select("doc_id", F.element_at(sources, (k % 6 + 1).cast("int")).alias("source"), F.lit(None).cast("string").alias("title"), body.alias("body_clean"), labels.alias("labels"), (k % 5 == 0).alias("known"), (k % 4 == 0).alias("att"))
    scored = df.withColumn("signal_score", normalize.signal_score(R.Rules(deal_terms=("zzdeal",)), known=F.col("known"), attachment=F.col("att")))
    return normalize.apply_gate(scored).select("doc_id", F.col("signal_score").alias("score"), (F.col("status") == "normalized").alias("passed"))


# Branches that the plain queries don't reach --------------------------------------------------------------------------
KINDS = ("company", "investor", "org", "school", "person", "deal")


@query("SELECT type, id, canonical, CAST(length(canonical) AS INTEGER) AS size, CAST(NULL AS DOUBLE) AS bad FROM entity", "entity")
def entity_views(t):
    """The typed view of each of the six kinds, one below the other; what does not cast is null."""
    attrs = F.create_map(F.lit("size"), F.length("canonical").cast("string"), F.lit("bad"), F.lit("x"))
    v, out = t.entity().withColumn("attrs", attrs), None
    for kind in KINDS:
        one = views.entity_view(v, kind, {"size": "int", "bad": "double"}).select(F.lit(kind).alias("type"), "id", "canonical", "size", "bad")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'p' || c_custkey AS id, 0 AS pos, 'Delhi University' AS school_name, 'BA' AS degree FROM customer")
def profile_schools(t):
    return profiles.profile_schools(parsed_people(t), "id").select("id", "pos", "school_name", "degree")


@query("WITH c AS (SELECT 'k' || p_partkey AS id, p_partkey % 3 AS t, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS core FROM part) SELECT id, min(id) OVER (PARTITION BY t, core) AS cluster, count(*) OVER (PARTITION BY t, core) AS size FROM c QUALIFY size > 1")
def core_kinds(t):
    """Cores by the rule of each type: investors, schools and companies, their names written in two ways."""
    k, n, odd = F.col("p_partkey"), F.col("p_name"), F.floor(F.col("p_partkey") / 3) % 2 == 1
    say = lambda a, b: F.when(odd, F.concat(*a)).otherwise(F.concat(*b))
    name = F.when(k % 3 == 0, say((n, F.lit(" Capital Management")), (F.lit("The "), n, F.lit(" Advisory LLP")))).when(k % 3 == 1, say((F.lit("University of "), n), (n, F.lit(" Polytechnic College")))).otherwise(say((n, F.lit(" Pvt. Ltd")), (F.upper(n), F.lit(" Technologies"))))
    kind = F.when(k % 3 == 0, "investor").when(k % 3 == 1, "school").otherwise("company")
    return dedup.core_clusters(t.part.select(F.concat(F.lit("k"), k).alias("id"), kind.alias("type"), name.alias("canonical")))


@query("SELECT id AS envelope_id, metric, CAST(v AS DOUBLE) AS value_num, CASE WHEN id % 2 = 0 THEN 'High' ELSE 'Medium' END AS confidence FROM (SELECT id, 'funding_ask' AS metric, ask AS v FROM note UNION ALL SELECT id, 'revenue', CASE WHEN id % 3 = 0 THEN id END FROM note UNION ALL SELECT id, 'ebitda', CASE WHEN id % 4 = 0 THEN -id END FROM note UNION ALL SELECT id, 'valuation', CASE WHEN id % 5 = 0 THEN 10 * id END FROM note) WHERE v IS NOT NULL", "note")
def all_observations(t):
    """The four metrics of a note, each where it has a number."""
    k, n = F.col("id"), t.note()
    df = n.select("*", F.when(k % 3 == 0, k).alias("revenue"), F.when(k % 4 == 0, -k).alias("ebitda"), F.when(k % 5 == 0, (10 * k).cast("string")).alias("valuation"), F.when(k % 2 == 0, "HIGH").otherwise("low").alias("confidence"))
    return knowledge.fan_out_observations(df, {"ask": "funding_ask", "revenue": "revenue", "ebitda": "ebitda", "valuation": "valuation"}).select("envelope_id", "metric", "value_num", "confidence")


@query("WITH own AS (SELECT id FROM company WHERE sector = 'BUILDING'), kept AS (SELECT id FROM own UNION SELECT src FROM involves WHERE dst IN (SELECT id FROM own) UNION SELECT id FROM investor) SELECT src, rel, dst FROM edge WHERE rel IN ('involves', 'invests_in') AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)", "edge", "company", "investor")
def sector_graph(t):
    """Companies of a sector, the deals tied to them and all investors."""
    e = checkpoints.cut(t.edge())
    return graph.filter_graph(t.entity(), e, ["company", "deal", "investor"], ["involves", "invests_in"], ["BUILDING"]).select("src", "rel", "dst")


@query("SELECT conv_id, 'Talk' || chr(10) || chr(10) || array_to_string(list(text ORDER BY turn), chr(10) || chr(10))[:120000] AS text FROM conversations GROUP BY conv_id")
def titled_docs(t):
    return text.assemble(t.conversations.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("chunk")), "conv_id", "Talk")


@query("SELECT conv_id || '-' || turn AS id, 'preprocessed' AS status FROM conversations WHERE turn % 3 = 0")
def stream_stage(t):
    """A stage on a stream: it takes the rows of its status and leaves the others to theirs."""
    rows = stream_of(t, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 3 == 0, "normalized").otherwise("raw").alias("status"))
    return drained(t, streams.stage_stream(rows, "normalized", lambda d: d.withColumn("status", F.lit("preprocessed"))))
