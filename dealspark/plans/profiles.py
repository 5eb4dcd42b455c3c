"""Registered queries over nested records, profiles, filings, retrieval and views, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import knowledge, profiles, retrieval, views
from .derived import Tables
from .registry import query


def obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def even(c: str) -> Column:
    return F.col(c) % 2 == 0


# Nested companies and filings ---------------------------------------------------------------------------------------
def nested_companies(t: Tables) -> DataFrame:
    """Customers as nested records: every second has no USD amount, every third a person whose name is an object."""
    amount = F.col("c_acctbal") * 10000
    rev = obj(amount=obj(INR=obj(value=amount), USD=F.when(even("c_custkey"), obj(value=amount / 80))), asOnDate=obj(year=2020, month=3, day=31))
    name = F.when(F.col("c_custkey") % 3 == 0, F.to_json(obj(firstName="Asha", lastName="Rao"))).otherwise(F.lit("Ravi Sen"))
    rec = obj(
        id=F.col("c_custkey").cast("string"), name=F.col("c_name"), website=F.array(obj(url=F.concat(F.lit("https://c"), "c_custkey", F.lit(".com")))), shortDescription=F.concat(F.lit(" makes \n "), "c_mktsegment"),
        locations=F.array(obj(city=obj(name=F.col("c_nationkey").cast("string")))), primaryTaxonomy=F.array(F.array(obj(name=F.col("c_mktsegment")), obj(name="Parts"))), latestRevenue=rev,
        investors=F.array(obj(name=F.lit("Fund A"), institutionalInvestor=F.lit(None).cast("struct<name:string>")), obj(name=F.lit(None).cast("string"), institutionalInvestor=obj(name="Fund B"))), keyPeople=F.array(obj(name=name, designation="Founder")),
        totalEquityFunding=F.when(even("c_custkey"), obj(amount=obj(USD=obj(value=(F.col("c_custkey") % 1000) * 1e6)))),
    )
    rows = t.customer.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))  # JSON is the work, however few row groups the rows lie in
    return rows.select("c_custkey", F.to_json(rec).alias("json"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'https://c' || c_custkey || '.com' AS website, CAST(c_nationkey AS VARCHAR) AS city, c_mktsegment || ' > Parts' AS sector, 'makes ' || c_mktsegment AS short_description, round(CAST(c_acctbal AS DOUBLE) / 1000, 2) + 0.0::DOUBLE AS revenue_inr_cr, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS has_usd, '2020-03-31' AS revenue_as_on, 'Fund A; Fund B' AS investors, CASE WHEN c_custkey % 3 = 0 THEN 'Asha Rao (Founder)' ELSE 'Ravi Sen (Founder)' END AS key_people FROM customer")
def flat_companies(t):
    df = profiles.flatten_company(nested_companies(t))
    return df.select("id", "name", "website", "city", "sector", "short_description", (F.col("revenue_inr_cr") + 0.0).alias("revenue_inr_cr"), F.col("revenue_usd_m").isNotNull().cast("int").alias("has_usd"), "revenue_as_on", "investors", "key_people")


def nested_filings(t: Tables) -> DataFrame:
    """Orders as filings of their company, of seven kinds."""
    names = F.array(*[F.lit(x) for x in ("Form AOC-4", "MGT-7 filing", "CHG-1", "Valuation report", "PAS-3", "DPT-3", "Other paper")])
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("d", F.col("o_orderdate").cast("date"))
    rec = obj(id=F.col("o_orderkey").cast("string"), name=F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")), filingDate=obj(year=F.year("d"), month=F.month("d"), day=F.day("d")), registrar="R1")
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.to_json(rec).alias("json"))


NAMES = "['Form AOC-4', 'MGT-7 filing', 'CHG-1', 'Valuation report', 'PAS-3', 'DPT-3', 'Other paper'][o_orderkey % 7 + 1]"
KIND = "['Financials', 'Annual Return', 'Charge', 'Valuation', 'Allotment/Capital', 'Deposits', 'Other'][o_orderkey % 7 + 1]"
FILED = f"fl AS (SELECT 'c' || o_custkey AS company_id, c_name AS company, o_orderkey, {NAMES} AS name, {KIND} AS kind, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS filing_date FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {FILED} SELECT CAST(o_orderkey AS VARCHAR) AS id, company_id, name, filing_date, 'https://x.org/a/d/document/' || o_orderkey || '/' || lower(replace(name, ' ', '')) AS viewer_url FROM fl")
def flat_filings(t):
    return profiles.flatten_filing(nested_filings(t), "https://x.org").select("id", "company_id", "name", "filing_date", "viewer_url")


def filed(t: Tables) -> DataFrame:
    rows = profiles.flatten_filing(nested_filings(t), "https://x.org")
    docs, about = views.load_filings(rows, rows.select(F.col("company_id").alias("id"), F.col("company_name").alias("name")).distinct())
    return views.company_documents(docs, about, t.company())


ABOUT = "ab AS (SELECT company_id, company, kind, name || ' (' || filing_date || ')' AS title, filing_date, min(CAST(o_orderkey AS VARCHAR)) AS filing_id FROM fl WHERE kind <> 'Other' GROUP BY ALL)"


@query(f"WITH {FILED}, {ABOUT} SELECT company_id, company, kind, title, filing_date FROM ab")
def company_documents(t):
    return filed(t).select("company_id", "company", "kind", "title", "filing_date")


@query(f"WITH {FILED}, {ABOUT} SELECT company_id, kind, filing_date, row_number() OVER (PARTITION BY company_id, kind ORDER BY filing_date DESC) AS n FROM ab QUALIFY n <= 2")
def recent_filings(t):
    return views.recent_filings(filed(t), 2).select("company_id", "kind", "filing_date", "n")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 6")
def material_filings(t):
    return views.material_filings(profiles.flatten_filing(nested_filings(t), "https://x.org")).select(F.col("id").cast("long").alias("id"))


def flat_rows(t: Tables) -> DataFrame:
    """The flat companies with the columns that the loader reads."""
    df = profiles.flatten_company(nested_companies(t))
    return df.select("id", "name", "website", "sector", *[F.col(f"{m}_inr_cr").cast("string").alias(f"{m}_inr_cr") for m in ("revenue", "ebitda", "net_profit", "valuation")], *[f"{m}_as_on" for m in ("revenue", "ebitda", "net_profit", "valuation")], F.col("employee_count").cast("string").alias("employee_count"), F.col("total_equity_funding_usd_m").cast("string").alias("total_equity_funding_usd_m"), "investors", "key_people")


@query("SELECT c_name AS name, 'revenue' AS metric, round(CAST(c_acctbal AS DOUBLE) / 1000, 2) + 0.0::DOUBLE AS value_num, 'FY20' AS period FROM customer UNION ALL SELECT c_name, 'funding', (c_custkey % 1000) * 8.5::DOUBLE, NULL FROM customer WHERE c_custkey % 2 = 0")
def loaded_observations(t):
    none = t.customer.select(F.lit("-").alias("id"), F.lit("-").alias("name")).where("false")
    return knowledge.load_companies(flat_rows(t), none)[1].select("name", "metric", (F.col("value_num") + 0.0).alias("value_num"), "period")


@query("SELECT 'Fund A' AS src, 'invests_in' AS rel, 'renamed ' || c_custkey AS dst FROM customer UNION ALL SELECT 'Fund B', 'invests_in', 'renamed ' || c_custkey FROM customer UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Asha Rao' ELSE 'Ravi Sen' END, 'works_at', 'renamed ' || c_custkey FROM customer")
def loaded_links(t):
    names = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("renamed "), "c_custkey").alias("name"))
    return knowledge.load_companies(flat_rows(t), names)[2]


@query("SELECT * FROM (VALUES ('companies', (SELECT count(*) FROM customer)), ('observations', (SELECT count(*) + count_if(c_custkey % 2 = 0) FROM customer)), ('links', (SELECT 3 * count(*) FROM customer)), ('errors', 0)) v(what, n)")
def load_counts(t):
    none = t.customer.select(F.lit("-").alias("id"), F.lit("-").alias("name")).where("false")
    return views.load_counts(*knowledge.load_companies(flat_rows(t), none), nested_companies(t).where("json IS NULL"))


# Profiles -----------------------------------------------------------------------------------------------------------
def parsed_people(t: Tables) -> DataFrame:
    """Customers' profiles: three jobs of which the third repeats the first's company, and a school."""
    job = lambda name, end, slug: obj(companyName=name, companyUniversalName=slug, position="Analyst", startDate=obj(text="2019"), endDate=F.when(end, obj(text="2020")))
    now, past = F.concat(F.lit("Firm "), F.col("c_nationkey")), F.col("c_mktsegment")
    rec = obj(
        publicIdentifier=F.lower(F.regexp_replace("c_name", "#", "-")), firstName=F.when(even("c_custkey"), F.lit("Asha")), lastName=F.when(even("c_custkey"), F.lit("Rao")), headline="h",
        location=obj(linkedinText=F.when(even("c_custkey"), F.lit("Pune, Maharashtra, India")).otherwise("Paris"), countryCode=F.when(~even("c_custkey"), F.lit("fr"))),
        experience=F.array(job(now, F.lit(False), F.concat(F.lit("firm-"), F.col("c_nationkey"))), job(past, F.lit(True), F.lit(None).cast("string")), job(now, F.lit(True), F.lit(None).cast("string"))),
        education=F.array(obj(schoolName="Delhi University", degree="BA")), skills=F.array(obj(name="law"), obj(name=" ")), followerCount=F.col("c_custkey"),
    )
    return profiles.parse_profile(t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.to_json(rec).alias("json")), "id")


@query("SELECT 'p' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Asha Rao' ELSE 'Customer ' || split_part(c_name, '#', 2) END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Pune' ELSE 'Paris' END AS location_city, CASE WHEN c_custkey % 2 = 0 THEN 'India' ELSE 'France' END AS location_country, 'Firm ' || c_nationkey AS current_company, 'law' AS skills FROM customer")
def person_profiles(t):
    return parsed_people(t).select("id", "name", "location_city", "location_country", "current_company", F.array_join("skills", ",").alias("skills"))


@query("SELECT 'p' || c_custkey AS id, n AS pos, CASE n WHEN 1 THEN c_mktsegment ELSE 'Firm ' || c_nationkey END AS company_name, n = 0 AS current FROM customer, (SELECT unnest([0, 1, 2]) AS n)")
def profile_roles(t):
    return profiles.profile_roles(parsed_people(t), "id").select("id", "pos", "company_name", "current")


def firms(t: Tables) -> DataFrame:
    return t.nation.where("n_nationkey < 20").select(F.concat(F.lit("Firm "), "n_nationkey").alias("company_name"), F.concat(F.lit("g"), "n_nationkey").alias("id"))


@query("SELECT 'p' || c_custkey AS src, 'works_at' AS rel, CASE WHEN c_nationkey < 20 THEN 'g' ELSE 'org|firm' END || c_nationkey AS dst, true AS current FROM customer UNION ALL SELECT 'p' || c_custkey, 'works_at', 'org|' || lower(c_mktsegment), false FROM customer UNION ALL SELECT 'p' || c_custkey, 'studied_at', 'school|delhi', NULL FROM customer")
def profile_edges(t):
    return profiles.profile_edges(parsed_people(t), "id", firms(t))


@query("SELECT src, rel, dst FROM edge WHERE rel NOT IN ('works_at', 'studied_at') OR src NOT IN (SELECT 'p' || c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'p' || c_custkey, 'works_at', CASE WHEN c_nationkey < 20 THEN 'g' ELSE 'org|firm' END || c_nationkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'p' || c_custkey, 'works_at', 'org|' || lower(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'p' || c_custkey, 'studied_at', 'school|delhi' FROM customer WHERE c_custkey % 2 = 0", "edge")
def rebuilt_edges(t):
    made = profiles.profile_edges(parsed_people(t).where("substring(id, 2)::bigint % 2 = 0"), "id", firms(t))
    return profiles.rebuild_profile_edges(t.edge(), made).select("src", "rel", "dst")


@query("SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '11-50' ELSE '11+' END AS company_size, CASE WHEN s_suppkey % 3 = 0 THEN 'Pune, MH' ELSE 'Pune, India' END AS hq, 'Steel' AS industry, '1999' AS founded, 'a|b' AS specialties FROM supplier")
def company_profiles(t):
    rec = obj(
        name=F.col("s_name"), linkedinUrl="https://www.linkedin.com/company/x/", industries=F.array(obj(name="Steel")), employeeCountRange=obj(start=11, end=F.when(even("s_suppkey"), F.lit(50))), foundedOn=obj(year=1999),
        locations=F.array(obj(city="Pune", geographicArea=F.when(F.col("s_suppkey") % 3 == 0, F.lit("MH")), country="India")), specialities="a, b",
    )
    df = profiles.parse_company_profile(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.to_json(rec).alias("json")), "id")
    return df.select("id", "name", "company_size", "hq", "industry", "founded", F.array_join("specialties", "|").alias("specialties"))


@query("SELECT 'p' || c_custkey AS id, c_name AS person, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS followers, c_custkey % 3 <> 0 AS has_profile, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Pune, India' ELSE 'Paris, France' END AS location FROM customer")
def person_card(t):
    people = t.person().withColumns({"linkedin": F.lit(None).cast("string"), "email": F.lit(None).cast("string")})
    return profiles.person_card(people, parsed_people(t).where("substring(id, 2)::bigint % 3 <> 0")).select("id", "person", "followers", "has_profile", "location")


@query("SELECT 'p' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' Rao' ELSE c_name END AS canonical FROM customer")
def upgraded_names(t):
    found = t.person().select("id", F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, F.concat("canonical", F.lit(" Rao"))).otherwise("Other").alias("name"))
    return profiles.upgrade_names(t.person(), found)


@query("SELECT 'g' || n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'known' WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'https://www.linkedin.com/company/firm-' || n_nationkey END AS linkedin, n_nationkey <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) AS found FROM nation WHERE n_nationkey < 20")
def harvested_urls(t):
    roles = profiles.profile_roles(parsed_people(t), "id").withColumnRenamed("id", "person_id").join(firms(t).hint("merge"), "company_name")
    known = firms(t).select("id", F.when(F.col("id") == "g0", F.lit("known")).alias("linkedin"), F.lit(None).cast("string").alias("logo"))
    return profiles.harvest_company_urls(known, roles).select("id", "linkedin", "found")


@query("SELECT 'p' || c_custkey AS id, 'firm' || c_nationkey AS slug, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer QUALIFY size > 1")
def slug_groups(t):
    return profiles.slug_groups(t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.concat(F.lit("https://in.linkedin.com/in/FIRM"), "c_nationkey", F.lit("/?x=1")).alias("linkedin")))


@query("SELECT o_orderkey AS id, 'Asha Rao|' || CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE 'found' END || ';Ravi Sen|-' AS founders FROM orders")
def patched_founders(t):
    who = F.array(obj(name="Asha Rao", linkedin=F.when(even("o_orderkey"), F.lit("own"))), obj(name="Ravi Sen", linkedin=F.lit(None).cast("string")))
    people = t.region.where("r_regionkey = 0").select(F.lit("ASHA RAO").alias("person"), F.lit("found").alias("linkedin"))
    out = profiles.patch_founders(t.orders.select(F.col("o_orderkey").alias("id"), who.alias("founders")), people)
    return out.select("id", F.array_join(F.transform("founders", lambda f: F.concat(f["name"], F.lit("|"), F.coalesce(f["linkedin"], F.lit("-")))), ";").alias("founders"))


# Views --------------------------------------------------------------------------------------------------------------
@query("WITH a AS (SELECT l_orderkey, min(l_linenumber) AS first FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'Email' WHEN o_orderstatus = 'O' THEN 'Pitch deck (Drive)' ELSE 'Pitch deck (email)' END AS kind, 'ref' || first AS deck_ref FROM orders LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def email_log(t):
    env = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"), F.when(even("o_orderkey"), "gmail").otherwise("pdf").alias("source"), F.when(F.col("o_orderstatus") == "P", "skipped").otherwise("indexed").alias("status"), F.lit("t").alias("title"), F.when(F.col("o_orderstatus") == "O", "drive").alias("origin"), F.lit(None).cast("string").alias("source_url"))
    att = t.lineitem.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("envelope_id"), F.concat(F.lit("ref"), "l_linenumber").alias("storage_ref"), F.col("l_linenumber").alias("hash"))
    return views.email_log(env, att).select("id", "date", "kind", "deck_ref")


@query("WITH o AS (SELECT dst AS id, count(*) AS degree FROM works_at JOIN employer e ON e.id = dst WHERE e.type = 'org' GROUP BY 1 ORDER BY degree DESC, min(canonical), 1 LIMIT 20), tt AS (SELECT DISTINCT dst AS id, 'role ' || (CAST(substr(src, 2) AS BIGINT) % 9) AS title FROM works_at), r AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY id ORDER BY title) <= 6) SELECT o.id, degree, string_agg(title, ', ' ORDER BY title) AS context FROM o JOIN r USING (id) GROUP BY ALL", "works_at", "employer")
def summary_candidates(t):
    e = t.works_at().select("src", F.lit("works_at").alias("rel"), "dst", F.concat(F.lit("role "), F.substring("src", 2, 20).cast("long") % 9).alias("title"))
    return views.summary_candidates(t.employer().withColumn("summary", F.lit("")), e, 20).select("id", "degree", "context")


@query("WITH r AS (SELECT 'n' || c_nationkey AS referrer, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_nationkey <> 3) SELECT referrer, k // 7 AS block, n, list(c_name ORDER BY c_name) AS companies FROM r GROUP BY ALL")
def referrers(t):
    rows = t.customer.select(F.when(F.col("c_nationkey") != 3, F.concat(F.lit("n"), "c_nationkey")).alias("referrer"), F.col("c_name").alias("company"))
    return views.referrers(rows, 7)


@query("SELECT sector, count(*) AS n FROM company WHERE sector IS NOT NULL GROUP BY sector", "company")
def sector_sizes(t):
    return views.sector_sizes(t.company())


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, greatest(300 - count(*), 0) AS remaining FROM events GROUP BY 1")
def lookups(t):
    return views.lookups(t.events.select(F.col("ts").alias("at")), 300).withColumn("day", F.col("day").cast("string"))


@query("SELECT 'clerk ' || (o_orderkey % 11) AS owner FROM orders UNION SELECT s_name FROM supplier")
def owner_suggestions(t):
    return views.owner_suggestions(t.orders.select(F.concat(F.lit(" clerk "), F.col("o_orderkey") % 11).alias("owner")), t.supplier.select(F.col("s_name").alias("canonical")))


@query("SELECT id, id IN (SELECT src FROM works_at WHERE dst = 'g1') AS internal FROM person", "works_at", "person")
def internal_flags(t):
    return views.flag_internal(t.person(), t.works_at(), "g1").select("id", "internal")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'unlisted ' || c_custkey ELSE c_name END AS canonical FROM customer")
def canonical_names(t):
    notes = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("unlisted "), "c_custkey")).when(F.col("c_custkey") % 3 == 1, F.upper("c_name")).otherwise(F.concat(F.lit("alias "), "c_custkey")).alias("company_name"))
    v = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical"), F.array(F.concat(F.lit("Alias "), "c_custkey")).alias("aliases"))
    return views.canonicalize_names(notes, v).select("id", "canonical")


@query("SELECT 'c' || c_custkey AS id, CAST(c_acctbal AS DECIMAL(12, 2))::DOUBLE AS balance, CAST(NULL AS INTEGER) AS bad FROM customer")
def company_view(t):
    v = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("company").alias("type"), F.col("c_name").alias("canonical"), F.create_map(F.lit("balance"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("bad"), F.lit("x")).alias("attrs"))
    return views.entity_view(v, "company", {"balance": "double", "bad": "int"}).select("id", "balance", "bad")


@query("SELECT 'p' || c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0")
def enrich_candidates(t):
    name = F.when(F.col("c_custkey") % 5 == 0, "Asha").otherwise("Asha Rao")
    people = t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("id"), name.alias("canonical"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("linkedin"))
    return views.enrich_candidates(people, people.where("substring(id, 2)::bigint % 3 = 0")).select("id")


@query("SELECT 'a' || o_custkey || '@x.org' AS src, 'organized' AS rel, 'meeting|' || o_orderkey AS dst FROM orders UNION SELECT x || o_custkey || '@x.org', 'attended', 'meeting|' || o_orderkey FROM orders, (SELECT unnest(['a', 'b']) AS x)")
def meeting_edges(t):
    who = lambda x: F.concat(F.lit(x), "o_custkey", F.lit("@X.org"))
    ev = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("call").alias("title"), who("A").alias("organizer"), F.array(who("a"), who("b"), F.lit(" ")).alias("attendees"))
    return views.resolve_meetings(ev)[1]


@query("SELECT 'doc|' || n.id AS src, 'about' AS rel, c.id AS dst FROM note n JOIN company c ON canonical = company_name UNION SELECT 'p' || n.id % 7, 'mentions', c.id FROM note n JOIN company c ON canonical = company_name WHERE n.id % 2 = 0", "note", "company")
def about_edges(t):
    env = t.note().select("id", "company_name", F.when(even("id"), F.concat(F.lit("p"), F.col("id") % 7)).alias("sender_id"))
    return views.resolve_about(env, t.company())


@query("SELECT doc_id, 0 AS seq, CASE WHEN doc_id % 4 BETWEEN 1 AND 2 THEN doc_id % 4 END AS page FROM documents WHERE trim(text, ' ') <> ''")
def caption_pages(t):
    c = F.array(obj(page=(F.col("doc_id") % 4).cast("string"), text=F.col("text")), obj(page="x", text=" "))
    return views.caption_chunks(t.documents.select("doc_id", F.lit(2).alias("n_pages"), c.alias("captions")), "doc_id").select("doc_id", "seq", "page")


@query("SELECT c_custkey, c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN 'Second,Third' ELSE '' END AS others FROM customer")
def coerced_notes(t):
    one = F.to_json(obj(company_name=F.col("c_name")))
    many = F.concat(F.lit("["), one, F.lit(', {"company_name": "Second"}, {"company_name": "Third"}]'))
    note, others = views.coerce_note(F.when(even("c_custkey"), many).otherwise(one))
    return t.customer.select("c_custkey", F.get_json_object(note, "$.company_name").alias("company"), F.array_join(others, ",").alias("others"))


@query("SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 'skipped' ELSE 'normalized' END AS status FROM documents")
def skipped_empty(t):
    return views.skip_empty(t.documents.select("doc_id", F.lit("normalized").alias("status"), F.col("text").alias("body_clean"))).select("doc_id", "status")


# Retrieval ----------------------------------------------------------------------------------------------------------
def noted(t: Tables) -> DataFrame:
    return t.note().select("*", F.lit(None).cast("string").alias("stage"), F.col("round_type").alias("revenue"), F.lit(None).cast("double").alias("valuation"))


FACT = "fx AS (SELECT company_name, '- ' || company_name || ' · ' || coalesce(sector, '?') || ' · ? · ask ' || CASE WHEN ask IS NULL THEN '-' ELSE 'set' END || ' · rev ' || coalesce(round_type, '-') || ' · val -' AS fact FROM note QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY ingested_at DESC NULLS LAST, id DESC) = 1)"


@query(f"WITH {FACT} SELECT company_name, fact FROM fx", "note")
def deal_facts(t):
    return retrieval.deal_facts(noted(t).withColumn("ask", F.when(F.col("ask").isNotNull(), "set")))


def asked(t: Tables) -> DataFrame:
    """Questions by nation, each naming the least customer's name of it."""
    return t.customer.groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.concat(F.lit("How is "), F.min("c_name"), F.lit(" doing?")).alias("text"))


@query(f"WITH {FACT}, q AS (SELECT c_nationkey AS doc_id, min(c_name) AS company_name FROM customer GROUP BY 1) SELECT doc_id, '## ' || company_name || chr(10) || substr(fact, 3) AS dossier FROM q JOIN fx USING (company_name)", "note")
def dossiers(t):
    return retrieval.dossier(asked(t), noted(t).withColumn("ask", F.when(F.col("ask").isNotNull(), "set")))


@query(f"WITH {FACT}, q AS (SELECT c_nationkey AS doc_id, min(c_name) AS company_name FROM customer GROUP BY 1) SELECT doc_id, coalesce('## ' || q.company_name || chr(10) || substr(fact, 3), '(the question names no known company)') AS dossier, coalesce('[' || n_name || ']' || chr(10) || n_name, '(no matching excerpts)') AS excerpts FROM q LEFT JOIN fx USING (company_name) LEFT JOIN nation ON n_nationkey = doc_id AND n_regionkey <> 1", "note")
def context_bundle(t):
    hits = t.nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("rank"), F.col("n_name").alias("label"), F.col("n_name").alias("text"))
    return retrieval.context(asked(t), noted(t).withColumn("ask", F.when(F.col("ask").isNotNull(), "set")), hits)
