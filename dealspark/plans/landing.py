"""Registered queries of landing, mapping, matching and streaming, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checkpoints, gold, graph, knowledge, normalize, text, upsert
from ..sources import raw
from ..streaming import streams
from .derived import Tables
from .registry import query, status_log


def obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


# Landing ------------------------------------------------------------------------------------------------------------
@query("SELECT 'm' || event_id AS id, event_type AS text FROM events WHERE event_id % 10 <> 0")
def webhook_messages(t):
    ident = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("m"), "event_id"))
    body = F.to_json(obj(messages=F.array(obj(id=ident, text=F.col("event_type")))))
    return raw.explode_messages(t.events.select(body.alias("body"))).select("id", "text")


def spine(t: Tables) -> tuple[DataFrame, DataFrame]:
    return raw.load_spine(t.customer.select(F.col("c_name").alias("Company"), F.concat(F.lit("Fund "), F.col("c_nationkey"), F.lit(", Fund X")).alias("INVESTORS"), F.col("c_mktsegment").alias("Sector")))


@query("SELECT 'company' AS type, c_name AS canonical FROM customer UNION SELECT 'deal', c_name || ' — Round' FROM customer UNION SELECT 'investor', 'Fund ' || c_nationkey FROM customer UNION SELECT 'investor', 'Fund X' FROM customer")
def spine_entities(t):
    return spine(t)[0].select("type", "canonical")


@query("SELECT c_name || ' — Round' AS src, 'involves' AS rel, c_name AS dst FROM customer UNION ALL SELECT 'Fund ' || c_nationkey, 'invested_in', c_name || ' — Round' FROM customer UNION ALL SELECT 'Fund X', 'invested_in', c_name || ' — Round' FROM customer")
def spine_edges(t):
    return spine(t)[1]


def lines(t: Tables) -> DataFrame:
    k = F.col("event_id") % 10
    return t.events.select(F.when(k == 0, "[1]").when(k == 1, "{bad").when(k == 2, " ").otherwise(F.to_json(obj(id=F.col("event_id"), kind=F.col("event_type")))).alias("value"))


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 10 > 2")
def jsonl_good(t):
    return raw.read_jsonl(lines(t), "id bigint, kind string")[0]


@query("SELECT CASE event_id % 10 WHEN 0 THEN '[1]' ELSE '{bad' END AS value, count(*) AS n FROM events WHERE event_id % 10 < 2 GROUP BY 1")
def jsonl_bad(t):
    return raw.read_jsonl(lines(t), "id bigint")[1].groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT event_id || '@2024' AS source_id FROM events WHERE event_type <> 'click'")
def calendar_versions(t):
    df = t.events.select(F.col("event_id").alias("id"), F.lit("2024").alias("updated"), F.when(F.col("event_type") == "click", "cancelled").alias("status"))
    return raw.land_events(df).select("source_id")


@query("SELECT sha256(CASE WHEN page_id % 4 = 0 THEN html ELSE '%PDF-' || (page_id // 2) END) AS hash, CASE WHEN page_id % 4 = 0 THEN 'invalid' WHEN page_id % 4 IN (1, 2) OR page_id % 4 = 3 AND page_id - 1 < 0 THEN 'landed' ELSE 'skipped' END AS status FROM pages WHERE html IS NOT NULL")
def landed_files(t):
    p = t.pages.where("html IS NOT NULL").select(F.format_string("f%09d", "page_id").alias("path"), F.encode(F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-"), F.floor(F.col("page_id") / 2).cast("string"))), "UTF-8").alias("content"))
    return raw.land_files(p).select("hash", "status")


def mail_parts(t: Tables) -> DataFrame:
    data = lambda c: F.base64(F.encode(c, "UTF-8"))
    html = obj(mime="text/html", filename="", data=data(F.concat(F.lit("<b>x</b> "), "c_name")))
    plain = obj(mime="text/plain", filename="", data=data(F.col("c_name")))
    deck = obj(mime="application/octet-stream", filename=F.when(F.col("c_custkey") % 3 == 0, "Deck.PDF").otherwise("a.txt"), data=F.lit(""))
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array(html, plain, deck)).otherwise(F.array(html, deck)).alias("parts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'x ' || c_name END AS text FROM customer")
def message_texts(t):
    return raw.message_text(mail_parts(t)).select("c_custkey", "text")


@query("SELECT c_custkey, 'Deck.PDF' AS filename FROM customer WHERE c_custkey % 3 = 0")
def mail_decks(t):
    return raw.pdf_parts(mail_parts(t)).select("c_custkey", F.col("part.filename").alias("filename"))


@query("SELECT o_custkey AS id FROM orders WHERE o_custkey % 4 <> 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0")
def worklist(t):
    a = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"))
    return raw.worklist([a, b], b.where("id % 4 = 0"))


@query("SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d %H:%M') AS mark FROM events GROUP BY 1")
def cursors(t):
    return raw.next_mark(status_log(t)).select("source", F.date_format("mark", "yyyy-MM-dd HH:mm").alias("mark"))


@query("SELECT c_custkey, ['slides', 'docs', 'folder', 'file'][c_custkey % 4 + 1] AS kind, lpad(CAST(c_custkey AS VARCHAR), 24, 'a') AS id FROM customer")
def share_urls(t):
    ident = F.lpad(F.col("c_custkey").cast("string"), 24, "a")
    stems = F.array(*[F.lit(f"https://x.org/{p}") for p in ("presentation/d/", "document/d/", "drive/folders/", "open?id=")])
    return t.customer.select("c_custkey", S.parse_share_url(F.concat(F.element_at(stems, (F.col("c_custkey") % 4 + 1).cast("int")), ident)).alias("u")).select("c_custkey", "u.kind", "u.id")


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 24, 'b') AS first, 2 AS n FROM customer")
def collected_ids(t):
    ident = F.lpad(F.col("c_custkey").cast("string"), 24, "b")
    json = F.to_json(obj(a=obj(id=ident), b=F.array(obj(id=ident), obj(id="c" * 24), obj(id="short"))))
    ids = S.collect_ids(json)
    return t.customer.select("c_custkey", ids[0].alias("first"), F.size(ids).alias("n"))


# Mappers ------------------------------------------------------------------------------------------------------------
@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'Re: ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'deal-flow,has-attachment' ELSE 'deal-flow' END AS labels, sha256(o_orderkey || 'Re: ' || o_orderpriority || 'body') AS content_hash FROM orders")
def envelopes_mail(t):
    heads = F.array(obj(name="SUBJECT", value=F.concat(F.lit("Re: "), "o_orderpriority")))
    df = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread_id"), F.lit(0).cast("long").alias("internal_date"), heads.alias("headers"), F.array(F.lit("L7"), F.lit("deal-flow")).alias("label_ids"), F.lit("body").alias("body"), (F.col("o_orderkey") % 2 == 0).alias("has_attachment"))
    return normalize.map_mail(df, {"L7": "deal-flow"}).select("source_id", "title", F.array_join("labels", ",").alias("labels"), "content_hash")


@query("SELECT event_id || '@u' AS source_id, CASE WHEN event_id % 2 = 0 THEN 'external-meeting' ELSE '' END AS labels, 'agenda' AS body_clean, sha256(event_id || 'u') AS content_hash FROM events")
def envelopes_events(t):
    guests = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a@own.org"), F.lit("b@other.org"))).otherwise(F.array(F.lit("a@own.org")))
    df = t.events.select(F.col("event_id").cast("string").alias("id"), F.lit("u").alias("updated"), F.lit("2024-01-01").alias("start"), F.lit("call").alias("summary"), F.lit("agenda\nJoin Zoom now").alias("description"), guests.alias("attendees"))
    return normalize.map_event(df, ("own.org",)).select("source_id", F.array_join("labels", ",").alias("labels"), "body_clean", "content_hash")


@query("SELECT CAST(page_id AS VARCHAR) AS source_id, CASE WHEN page_id % 2 = 0 THEN 'native' ELSE 'binary' END AS labels, sha256(page_id || CASE WHEN page_id % 3 = 0 THEN 'r1' ELSE 'm1' END) AS content_hash FROM pages")
def envelopes_files(t):
    df = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("f").alias("name"), F.when(F.col("page_id") % 2 == 0, "application/vnd.google-apps.document").otherwise("application/pdf").alias("mime"), F.when(F.col("page_id") % 3 == 0, "r1").alias("revision"), F.lit("m1").alias("md5"), F.lit("2024-01-01").alias("modified"), F.col("html").alias("text"))
    return normalize.map_file(df).select("source_id", F.array_join("labels", ",").alias("labels"), "content_hash")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS source_id, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS body_raw FROM nation""")
def envelopes_records(t):
    return normalize.map_record(t.nation.select("n_nationkey", "n_name"), "n_nationkey").select("source_id", "body_raw")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE text END AS body, CASE WHEN turn % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS signal_score FROM conversations")
def redacted(t):
    df = t.conversations.select("conv_id", "turn", F.col("text").alias("body_clean"), F.when(F.col("turn") % 2 == 0, "confidential_hr").alias("reason"), F.lit(0.5).alias("signal_score"))
    return normalize.redact(df).select("conv_id", "turn", F.col("body_clean").alias("body"), "signal_score")


@query("SELECT c_custkey, c_name || chr(10) || 'see you' AS body FROM customer")
def cleaned_bodies(t):
    mail = F.concat(F.lit("---- Forwarded message ----\nFrom: a@x.org\nSubject: hi\n"), "c_name", F.lit("\nsee  you\n> old\nOn 1 May A wrote:\n-- \nsignature"))
    return t.customer.select("c_custkey", S.clean_body(mail).alias("body"))


# Scalars ------------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, 'Ravi Sen' AS first_name, 'r.sen' || c_custkey || '@x.org' AS first_email, 2 AS n FROM customer")
def contacts(t):
    c = S.parse_contacts(F.concat(F.lit('"Ravi Sen" <R.Sen'), "c_custkey", F.lit('@x.org>, nobody, "Rao, Asha" <asha@x.org>')))
    return t.customer.select("c_custkey", c[0]["name"].alias("first_name"), c[0]["email"].alias("first_email"), F.size(c).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Fintech|SaaS' ELSE 'Healthcare' END AS sectors, CASE p_partkey % 3 WHEN 0 THEN 'Seed' ELSE 'Buyout' END AS stage, 'FY' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') AS period, p_name AS person, 'CEO' AS role, p_name || '|b' AS items, p_size * 8.5::DOUBLE AS crore FROM part")
def value_rules(t):
    third = F.col("p_partkey") % 3 == 0
    p = S.parse_person(F.concat("p_name", F.lit(" (CEO)")))
    day = F.concat(F.lit("20"), F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lit("-03-31"))
    return t.part.select("p_partkey", F.array_join(S.sectors_of(F.when(third, "banking, software/Finance").otherwise("Hospitals and HealthTech")), "|").alias("sectors"), S.canon_stage(F.when(third, "Pre-Seed").otherwise("M&A")).alias("stage"), S.fy_period(day).alias("period"), p["name"].alias("person"), p["role"].alias("role"), F.array_join(S.split_list(F.concat("p_name", F.lit("; ;b ;"))), "|").alias("items"), S.usd_m_to_cr("p_size").cast("double").alias("crore"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Acme Widgets|AW' ELSE '' END AS aliases, s_suppkey % 2 = 0 AS named, 'https://www.linkedin.com/in/asha-' || s_suppkey AS url, 'asha-' || s_suppkey AS slug, true AS fits FROM supplier")
def name_rules(t):
    name = F.when(F.col("s_suppkey") % 2 == 0, "Acme Widgets Pvt Ltd").otherwise("X1")
    url = F.concat(F.lit("http://in.linkedin.com/in/asha-"), "s_suppkey", F.lit("/?trk=1"))
    return t.supplier.select("s_suppkey", F.array_join(S.make_aliases(name), "|").alias("aliases"), S.is_person_name(name).alias("named"), S.norm_profile_url(url).alias("url"), S.profile_slug(url).alias("slug"), S.slug_matches_name(url, F.lit("Asha Rao")).alias("fits"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN round((1000 * 0.3 + 10 * 2.5) / 1e6, 5) ELSE NULL END AS usd FROM events")
def token_costs(t):
    return t.events.select("event_id", S.llm_usd(F.when(F.col("event_type") == "click", "fast"), F.lit(1000), F.lit(10), {"fast": (0.3, 2.5)}).alias("usd"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS confidence FROM orders")
def salvaged_json(t):
    k = F.col("o_orderkey") % 3
    answer = F.when(k == 0, '```json\n{"confidence": "high"}\n```').when(k == 1, 'Sure: {"confidence": "mid"} done').otherwise("no idea {")
    return t.orders.select("o_orderkey", S.salvage_json(answer, "confidence string")["confidence"].alias("confidence"))


# Matching and merging -----------------------------------------------------------------------------------------------
@query("SELECT 'Alias ' || c_custkey AS name, 'c' || c_custkey AS id, 3 AS quality FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_name || ' Ltd', 'c' || c_custkey, 2 FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'Neo' || c_name || 'x', 'c' || c_custkey, 1 FROM customer WHERE c_custkey % 3 = 2")
def matched_companies(t):
    kind = F.col("c_custkey") % 3
    names = t.customer.select(F.when(kind == 0, F.concat(F.lit("Alias "), "c_custkey")).when(kind == 1, F.concat("c_name", F.lit(" Ltd"))).otherwise(F.concat(F.lit("Neo"), "c_name", F.lit("x"))).alias("name"))
    aliases = t.customer.where(kind == 0).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("alias "), "c_custkey").alias("alias"))
    return knowledge.match_company(names, t.company(), aliases, graph.degrees(t.edge()))


@query("SELECT 'K' || c_nationkey AS value, min('c' || c_custkey) AS id FROM customer GROUP BY 1")
def entities_by_key(t):
    keys = t.customer.select(F.concat(F.lit("k"), "c_nationkey").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    return knowledge.entity_by_key(keys, t.nation.select(F.concat(F.lit("K"), "n_nationkey").alias("value")))


@query("SELECT company_name AS person, min_by(round_type, (occurred_at, id)) FILTER (round_type IS NOT NULL) AS role, max_by(sector, (occurred_at, id)) AS company, count(*) AS mentions FROM note GROUP BY 1", "note")
def vault_people(t):
    return gold.merge_people(t.note().select(F.col("company_name").alias("person"), F.col("round_type").alias("role"), F.col("sector").alias("company"), F.col("occurred_at").alias("at"), "id"))


@query("WITH i AS (SELECT company_name, round_type AS item, min((occurred_at, id)) AS tm FROM note WHERE round_type IS NOT NULL GROUP BY 1, 2) SELECT company_name, string_agg(item, '|' ORDER BY tm, item) AS items FROM i GROUP BY 1", "note")
def merged_lists(t):
    df = t.note().where("round_type IS NOT NULL").select("company_name", F.array("round_type").alias("items"), "occurred_at", "id")
    return gold.merge_lists(df, "company_name", "items", "occurred_at", "id").select("company_name", F.array_join("items", "|").alias("items"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS headline FROM customer")
def upserted_profiles(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.lit("old").alias("headline"), F.lit(1).alias("seq"))
    return upsert.upsert_profiles(base, base.where("id % 2 = 0").withColumns({"headline": F.lit("new"), "seq": F.lit(2)}), "id", "seq").select("id", "headline")


@query("SELECT c_custkey AS id, n_name || chr(10) || c_mktsegment AS chunk FROM customer JOIN nation ON n_nationkey = c_nationkey")
def synthetic_chunks(t):
    df = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return df.select(F.col("c_custkey").alias("id"), text.synthetic_chunk("n_name", "c_mktsegment", F.lit(None).cast("string")).alias("chunk"))


@query("SELECT l_orderkey AS question, l_returnflag AS company, l_linestatus AS title, 1 AS page, min(CAST(l_quantity AS DOUBLE)) AS distance FROM lineitem GROUP BY ALL")
def context_sources(t):
    hits = t.lineitem.select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("company"), F.col("l_linestatus").alias("title"), F.lit(1).alias("page"), F.col("l_quantity").cast("double").alias("distance"))
    return text.dedup_sources(hits)


# Streams: what is there now, written and read again -----------------------------------------------------------------
def drained(t: Tables, name: str, df: DataFrame) -> DataFrame:
    """The stream's output as a table in the shared folder."""
    home = checkpoints.folder(t.spark)
    streams.run_available(df, f"{home}/{name}/out", f"{home}/{name}/log")
    return t.spark.read.schema(df.schema).parquet(f"{home}/{name}/out")


def chat_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.conversations.schema).parquet(f"{t.dir}/conversations.parquet*")


@query("SELECT conv_id || '-' || turn AS source_id, CASE WHEN length(trim(text, ' ')) < 20 THEN 'skipped' ELSE 'normalized' END AS status FROM conversations")
def stream_normalize(t):
    df = chat_stream(t).select(F.lit("chat").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body"))
    return drained(t, "normalized", streams.stream_normalize(df).select("source_id", "status"))


@query("SELECT DISTINCT 'chat' AS source, CAST(conv_id AS VARCHAR) AS source_id FROM conversations")
def stream_dedup(t):
    df = chat_stream(t).select(F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("source_id"), F.timestamp_seconds("turn").alias("at"))
    return drained(t, "landed", streams.stream_land(df)).select("source", "source_id")
