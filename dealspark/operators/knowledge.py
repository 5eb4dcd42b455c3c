"""Notes to entities, edges, observations and tasks; actors and domains to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def deal_name(company="company_name", round_type="round_type"):
    return F.concat(F.col(company), F.lit(" — "), F.coalesce(F.col(round_type), F.lit("Round")))


def fan_out_entities(notes: DataFrame) -> DataFrame:
    """(type, canonical): companies, people named well, investors, and a deal where a round or an ask is set.

    notes: (company_name, round_type, ask, founders ARRAY<STRING>, investors ARRAY<STRING>); the arrays may be null."""
    company = notes.select(F.lit("company").alias("type"), F.col("company_name").alias("canonical"))
    people = notes.select(F.lit("person").alias("type"), F.explode("founders").alias("canonical")).where(S.is_person_name("canonical"))
    investors = notes.select(F.lit("investor").alias("type"), F.explode("investors").alias("canonical")).where(S.is_investor_name("canonical"))
    deals = notes.where("round_type IS NOT NULL OR ask IS NOT NULL").select(F.lit("deal").alias("type"), deal_name().alias("canonical"))
    return company.unionByName(people).unionByName(investors).unionByName(deals).where("canonical IS NOT NULL").distinct()


#: Fields of a note that describe its company.
COMPANY_FIELDS = ("sector", "sub_sector", "stage", "business_model", "hq", "website", "founded", "poc", "fitment")


def fan_out_attributes(notes: DataFrame, order: str = "occurred_at") -> DataFrame:
    """(type, canonical, attrs): what the notes say of each entity of `fan_out_entities`, field by field the newest value
    that is not null (then that of the greatest id); an entity of which nothing is said has an empty map.

    Companies have COMPANY_FIELDS as far as the notes have them; people their role, company, address and relation (founders
    and key_people: arrays of struct(name, role, linkedin)); deals their company, round, ask and that they are active."""
    at = F.struct(F.col(order), F.col("id")).alias("at")
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), text(v).alias("v"))
    said = lambda kind, name, pairs, df: df.select(F.lit(kind).alias("type"), F.trim(name).alias("canonical"), at, F.array(*pairs).alias("said"))
    out = said("company", F.col("company_name"), [pair(c, c) for c in COMPANY_FIELDS if c in notes.columns], notes).where(S.is_company_name("canonical"))
    for column, relation in (("founders", "founder"), ("key_people", "contact")):
        if column in notes.columns:
            each = notes.select("*", F.explode(column).alias("p"))
            out = out.unionByName(said("person", F.col("p.name"), [pair("role", "p.role"), pair("company", "company_name"), pair("linkedin", "p.linkedin"), pair("relation", F.lit(relation))], each).where(S.is_person_name("canonical")))
    deals = notes.where("round_type IS NOT NULL OR ask IS NOT NULL")
    out = out.unionByName(said("deal", deal_name(), [pair("company", "company_name"), pair("round_type", "round_type"), pair("ask", "ask"), pair("status", F.lit("active"))], deals))
    each = out.where("canonical <> ''").select("type", "canonical", "at", F.explode("said").alias("s")).groupBy("type", "canonical", F.col("s.k").alias("k")).agg(F.max_by("s.v", F.when(F.col("s.v").isNotNull(), F.col("at"))).alias("v"))
    return each.groupBy("type", "canonical").agg(F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["v"].isNotNull()))).alias("attrs"))


def sender_edges(actors: DataFrame, companies: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """(src, rel, dst): a resolved sender (person_id, actor) works at the company of their address's domain; addresses of
    generic domains, and those that are none, say nothing."""
    senders = actors.where(F.col("actor").contains("@")).select(F.lower("actor").alias("sender"), "person_id").distinct()
    homes = resolve_domains(senders.select("sender").distinct(), companies, generic)
    return senders.join(homes.hint("merge"), "sender").select(F.col("person_id").alias("src"), F.lit("works_at").alias("rel"), F.col("company_id").alias("dst")).distinct()


def named_senders(actors: DataFrame) -> DataFrame:
    """(actor, canonical) of new people: the display name if it is a name, else the address's local part, else the actor."""
    shown = S.blank_to_null("display")
    return actors.select("actor", F.coalesce(F.when(S.is_person_name(shown), shown), F.when(F.col("actor").contains("@"), S.name_from_email("actor")), F.col("actor")).alias("canonical"))


def fan_out_edges(notes: DataFrame) -> DataFrame:
    works = notes.select(F.explode("founders").alias("src"), F.lit("works_at").alias("rel"), F.col("company_name").alias("dst")).where(S.is_person_name("src"))
    invests = notes.select(F.explode("investors").alias("src"), F.lit("invests_in").alias("rel"), F.col("company_name").alias("dst")).where(S.is_investor_name("src"))
    deals = notes.where("round_type IS NOT NULL OR ask IS NOT NULL").select(deal_name().alias("src"), F.lit("involves").alias("rel"), F.col("company_name").alias("dst"))
    return works.unionByName(invests).unionByName(deals).distinct()


def fan_out_observations(notes: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row per note and metric that has a number; metrics: column to metric name."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value_num")) for c, m in metrics.items()])
    rows = notes.select("id", "company_name", "occurred_at", F.col("confidence").alias("c"), F.explode(each).alias("x")).where("x.value_num IS NOT NULL")
    return rows.select(F.col("id").alias("envelope_id"), "company_name", "x.metric", "x.value_num", F.lit("INR_Cr").alias("unit"), F.col("occurred_at").alias("as_of"), F.when(F.lower("c") == "high", "High").otherwise("Medium").alias("confidence")).dropDuplicates(["envelope_id", "metric"])


def fan_out_tasks(notes: DataFrame, items: str = "action_items") -> DataFrame:
    return notes.select(F.col("id").alias("envelope_id"), "company_name", F.explode(items).alias("description")).where(F.trim("description") != "").dropDuplicates(["envelope_id", "description"])


def load_companies(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, observations, links) of third-party rows; names (id, name) renames, the first by name order."""
    first = names.groupBy("id").agg(F.min("name").alias("_name"))
    df = rows.join(first, "id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    metric = lambda m, v, on, unit: F.struct(F.lit(m).alias("metric"), S.num_or_null(v).alias("value_num"), (F.col(on) if on else F.lit(None).cast("string")).alias("as_of"), F.lit(unit).alias("unit"))
    funding = F.struct(F.lit("funding").alias("metric"), S.usd_m_to_cr(S.num_or_null("total_equity_funding_usd_m")).alias("value_num"), F.lit(None).cast("string").alias("as_of"), F.lit("INR_Cr").alias("unit"))
    each = F.array(*[metric(m, f"{m}_inr_cr", f"{m}_as_on", "INR_Cr") for m in ("revenue", "ebitda", "net_profit", "valuation")], metric("employees", "employee_count", None, "count"), funding)
    obs = df.select("name", F.explode(each).alias("x")).where("x.value_num IS NOT NULL").select("name", "x.*", S.fy_period("x.as_of").alias("period"))
    investors = df.select(F.explode(S.split_list("investors")).alias("src"), F.lit("invests_in").alias("rel"), F.col("name").alias("dst")).where(S.is_investor_name("src"))
    people = df.select(F.explode(S.split_list("key_people")).alias("p"), "name").select(S.parse_person("p")["name"].alias("src"), F.lit("works_at").alias("rel"), F.col("name").alias("dst")).where(S.is_person_name("src"))
    companies = df.select("name", S.canon_sector(F.split_part("sector", F.lit(">"), F.lit(1))).alias("sector"), S.web_key("website").alias("website"))
    return companies, obs, investors.unionByName(people).distinct()


def resolve_actors(actors: DataFrame, keys: DataFrame) -> DataFrame:
    """(envelope_id, actor, person_id, is_new): an actor by an e-mail or phone key, else a person made of the actor's hash."""
    best = keys.groupBy("key").agg(F.min("id").alias("_known"))
    out = actors.join(best, F.lower("actor") == F.col("key"), "left")
    return out.select("envelope_id", "actor", F.coalesce("_known", F.sha2(F.concat(F.lit("person|"), F.lower("actor")), 256)).alias("person_id"), F.col("_known").isNull().alias("is_new"))


def resolve_domains(senders: DataFrame, companies: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """(sender, company_id): by the domain of the sender's address, generic ones left out; the least id of a domain."""
    by = companies.select(S.domain_of("website").alias("domain"), "id").where("domain IS NOT NULL").groupBy("domain").agg(F.min("id").alias("company_id"))
    out = senders.withColumn("domain", F.split_part(F.lower("sender"), F.lit("@"), F.lit(2)))
    return (out.where(~F.col("domain").isin(*generic)) if generic else out).join(by, "domain").select("sender", "company_id")


def entity_by_key(keys: DataFrame, values: DataFrame) -> DataFrame:
    return values.join(keys, F.lower("value") == F.lower("key")).groupBy("value").agg(F.min("id").alias("id"))


def substrings(c, least: int = 1) -> Column:
    """All distinct substrings of at least `least` characters."""
    n = F.length(c)
    of = lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(c, i, k))
    return F.when(n >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - least + 1), of)))).otherwise(F.array().cast("array<string>"))


def match_company(names: DataFrame, companies: DataFrame, aliases: DataFrame, degree: DataFrame) -> DataFrame:
    """(name, id, quality): 3 exact name or alias, 2 equal core of name or alias, 1 one core inside the other.

    Companies whose own core is the name's are variants of one firm, so the best connected of them is taken, whatever its
    quality; else the best quality counts, then the degree, then the greatest id. Only names without a match of quality 2
    or 3 look for substrings: for each core and each substring of a core the best company is found first, so each substring
    of a name meets one row."""
    names = names.select("name").where(F.trim("name") != "").distinct().withColumn("low", F.lower(F.trim("name"))).withColumn("c", S.core_key("name"))
    own = companies.select("id", F.lower("canonical").alias("low"), S.core_key("canonical").alias("c")).join(degree.hint("merge"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    other = aliases.select("id", F.lower("alias").alias("low"), S.core_key("alias").alias("c"))
    both = own.select("id", "low", "c").unionByName(other)
    core = F.length("c") >= 3
    found = names.select("name", "low").join(both.select("id", "low").hint("merge"), "low").select("name", "id", F.lit(3).alias("quality"))
    found = found.unionByName(names.where(core).select("name", "c").join(both.where(core).select("id", "c").hint("merge"), "c").select("name", "id", F.lit(2).alias("quality")))
    found = found.groupBy("name", "id").agg(F.max("quality").alias("quality")).join(own.select("id", "degree", F.col("c").alias("core")).hint("merge"), "id").join(names.select("name", "c").hint("merge"), "name")
    same = (F.col("c") != "") & (F.col("core") == F.col("c"))
    order = F.struct(same, F.when(same, 0).otherwise(F.col("quality")), "degree", "id")
    good = found.groupBy("name").agg(F.max_by(F.struct("id", "quality"), order).alias("x")).select("name", "x.id", "x.quality")
    rest = names.where(F.length("c") >= 4).join(good.select("name").hint("merge"), "name", "left_anti").select("name", "c")
    best = F.max(F.struct("degree", "id")).alias("b")
    inner = own.where("c <> ''").groupBy("c").agg(best)
    outer = own.select("degree", "id", F.explode(substrings(F.col("c"), 4)).alias("c")).groupBy("c").agg(best)
    loose = rest.select("name", F.explode(substrings(F.col("c"))).alias("c")).join(inner.hint("merge"), "c").select("name", "b").unionByName(rest.join(outer.hint("merge"), "c").select("name", "b"))
    return good.unionByName(loose.groupBy("name").agg(F.max("b").alias("b")).select("name", "b.id", F.lit(1).alias("quality")))
