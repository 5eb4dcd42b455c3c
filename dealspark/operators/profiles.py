"""Nested third-party records and profiles (JSON text) as flat rows, and the edges, names and addresses they give.

Texts that a record lacks are "", numbers are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from .checkpoints import cut

AMOUNT = "amount:struct<INR:struct<value:double>,USD:struct<value:double>>"
DAY = "struct<year:int,month:int,day:int>"
MONEY = f"struct<{AMOUNT},asOnDate:{DAY},growthDetails:map<string,struct<CAGR:double>>>"
PLACE = "struct<city:struct<name:string>,state:struct<name:string>,country:struct<name:string>>"
COMPANY = (
    f"id string, name string, foundedYear int, website array<struct<url:string>>, stage string, shortDescription string, locations array<{PLACE}>, primaryTaxonomy array<array<struct<name:string>>>, "
    f"latestRevenue {MONEY}, latestEBITDA {MONEY}, latestNetProfit {MONEY}, latestValuation {MONEY}, latestEmployeeCount struct<value:long>, totalEquityFunding struct<{AMOUNT}>, "
    "investors array<struct<name:string,institutionalInvestor:struct<name:string>>>, keyPeople array<struct<name:string,person:struct<name:string>,designation:string,role:string,roles:array<string>>>, legalEntities array<struct<id:string>>"
)
FILING = f"id string, name string, documentType string, category string, filingType string, registrar string, filingDate {DAY}, documentCode string, metaProperties struct<cin:string>"
JOB = "position:string,companyName:string,companyLinkedinUrl:string,companyId:string,companyUniversalName:string,companyLogo:string,startDate:struct<text:string>,endDate:struct<text:string>"
PERSON = (
    "publicIdentifier string, linkedinUrl string, firstName string, lastName string, name string, headline string, location struct<linkedinText:string,countryCode:string,parsed:struct<city:string,text:string,country:string,countryFull:string,countryCode:string>>, "
    f"currentPosition array<struct<{JOB}>>, experience array<struct<{JOB}>>, education array<struct<schoolName:string,schoolLinkedinUrl:string,degree:string,fieldOfStudy:string,period:string>>, skills array<struct<name:string>>, followerCount long, connectionsCount long, photo string, profilePicture struct<url:string>"
)
FIRM = (
    "name string, companyName string, linkedinUrl string, universalName string, publicIdentifier string, industries array<string>, industry string, employeeCountRange struct<start:long,end:long>, companySize string, staffCountRange string, employeeCount long, staffCount long, "
    "foundedOn struct<year:int>, founded string, locations array<struct<city:string,geographicArea:string,country:string>>, headquarter struct<city:string,geographicArea:string,country:string>, specialities string, specialties string, website string, websiteUrl string, followerCount long, logo string"
)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def day_text(d: Column) -> Column:
    one = lambda x: F.coalesce(F.nullif(d[x], F.lit(0)), F.lit(1))
    return F.when(d["year"] > 0, F.format_string("%04d-%02d-%02d", d["year"], one("month"), one("day"))).otherwise("")


def full_name(c: Column) -> Column:
    """A name that is a text, or an object of its parts; the object is parsed once, as the item of a list of one."""
    blank = lambda x: F.when(x != "", x)
    whole = lambda p: F.coalesce(blank(F.concat_ws(" ", *[blank(p[k]) for k in ("firstName", "middleName", "lastName")])), blank(p["name"]))
    parsed = F.transform(F.array(F.from_json(c, "firstName string, middleName string, lastName string, name string")), whole)
    return F.when(c.startswith("{"), F.get(parsed, F.lit(0))).otherwise(blank(c))


def first_names(items: Column, label, n: int = 5) -> Column:
    """The labels of the first n items, those without one left out."""
    return F.array_join(F.filter(F.transform(F.slice(F.coalesce(items, F.array()), 1, n), label), lambda x: x.isNotNull()), "; ")


def flatten_company(df: DataFrame, json: str = "json") -> DataFrame:
    """One flat row per nested company record: crore of INR, millions of USD, first place, sector path, five names."""
    c = F.col("_c")
    crore = lambda m: F.round(c[m]["amount"]["INR"]["value"] / 1e7, 2)
    million = lambda m: F.round(c[m]["amount"]["USD"]["value"] / 1e6, 2)
    growth = lambda y: F.try_element_at(c["latestRevenue"]["growthDetails"], F.lit(y))["CAGR"]
    role = lambda p: F.coalesce(F.nullif(p["designation"], F.lit("")), F.nullif(p["role"], F.lit("")), F.get(p["roles"], F.lit(0)))
    named = lambda p: F.coalesce(full_name(p["name"]), full_name(p["person"]["name"]))
    place = F.get(c["locations"], F.lit(0))
    money = [x.alias(n) for m, stem in (("latestRevenue", "revenue"), ("latestEBITDA", "ebitda"), ("latestNetProfit", "net_profit"), ("latestValuation", "valuation")) for x, n in ((crore(m), f"{stem}_inr_cr"), (million(m), f"{stem}_usd_m"), (day_text(c[m]["asOnDate"]), f"{stem}_as_on"))]
    return df.where(F.col(json).isNotNull()).withColumn("_c", F.from_json(json, COMPANY)).select(
        text_of(c["id"]).alias("id"), text_of(c["name"]).alias("name"), text_of(F.get(c["website"], F.lit(0))["url"]).alias("website"), F.nullif(c["foundedYear"], F.lit(0)).alias("founded"), text_of(c["stage"]).alias("stage"),
        text_of(place["city"]["name"]).alias("city"), text_of(place["country"]["name"]).alias("country"), text_of(F.array_join(F.transform(F.get(c["primaryTaxonomy"], F.lit(0)), lambda n: text_of(n["name"])), " > ")).alias("sector"),
        F.trim(F.regexp_replace(text_of(c["shortDescription"]), r"\s+", " ")).alias("short_description"), *money, growth("oneYear").alias("revenue_growth_1y"), growth("threeYear").alias("revenue_growth_3y"), growth("fiveYear").alias("revenue_growth_5y"),
        F.nullif(c["latestEmployeeCount"]["value"], F.lit(0)).alias("employee_count"), million("totalEquityFunding").alias("total_equity_funding_usd_m"),
        first_names(c["investors"], lambda i: F.coalesce(full_name(i["name"]), full_name(i["institutionalInvestor"]["name"]))).alias("investors"),
        first_names(c["keyPeople"], lambda p: F.when(named(p).isNotNull(), F.concat(named(p), F.coalesce(F.concat(F.lit(" ("), role(p), F.lit(")")), F.lit(""))))).alias("key_people"),
        F.array_join(F.transform(F.coalesce(c["legalEntities"], F.array()), lambda x: text_of(x["id"])), "; ").alias("legal_entity_ids"),
    )


def flatten_filing(df: DataFrame, base_url: str, json: str = "json") -> DataFrame:
    """(company_id, company_name, json) to flat filing rows; a record without an id has no viewer address."""
    f = F.col("_f")
    slug = F.lower(F.regexp_replace(text_of(f["name"]), r"\s+", ""))
    return df.withColumn("_f", F.from_json(json, FILING)).select(
        F.lit("document").alias("kind"), "company_id", "company_name", text_of(f["id"]).alias("id"), text_of(f["name"]).alias("name"), text_of(f["documentType"]).alias("document_type"), text_of(f["category"]).alias("category"), text_of(f["filingType"]).alias("filing_type"),
        text_of(f["registrar"]).alias("registrar"), day_text(f["filingDate"]).alias("filing_date"), text_of(f["metaProperties"]["cin"]).alias("cin"), F.when(text_of(f["id"]) != "", F.concat_ws("/", F.lit(f"{base_url}/a/d/document"), f["id"], slug)).otherwise("").alias("viewer_url"), text_of(f["documentCode"]).alias("document_code"),
    )


def parse_profile(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """A person's nested profile: name and place by their chains of fallbacks, the current role, and the arrays."""
    p = F.col("_p")
    has = S.blank_to_null
    name = F.coalesce(has(F.concat_ws(" ", has(p["firstName"]), has(p["lastName"]))), has(p["name"]), F.initcap(F.trim(F.regexp_replace(text_of(p["publicIdentifier"]), "-", " "))))
    parsed, raw = p["location"]["parsed"], S.split_list(p["location"]["linkedinText"], ",")
    code = F.upper(F.coalesce(has(parsed["countryCode"]), has(p["location"]["countryCode"])))
    city = F.coalesce(has(parsed["city"]), has(parsed["text"]))
    country = F.coalesce(has(parsed["country"]), has(parsed["countryFull"]), F.when(F.size(raw) > 1, F.element_at(raw, -1)), S.lookup(code, R.COUNTRIES), code)
    now = F.coalesce(F.get(p["currentPosition"], F.lit(0)), F.get(p["experience"], F.lit(0)))
    return df.where(F.col(json).isNotNull()).withColumn("_p", F.from_json(json, PERSON)).select(
        key, F.regexp_replace(name, r"\s+", " ").alias("name"), p["linkedinUrl"].alias("linkedin_url"), p["publicIdentifier"].alias("public_id"), p["headline"].alias("headline"),
        F.coalesce(city, F.get(raw, F.lit(0))).alias("location_city"), country.alias("location_country"), now["position"].alias("current_title"), now["companyName"].alias("current_company"),
        F.coalesce(has(p["photo"]), p["profilePicture"]["url"]).alias("photo_url"), p["followerCount"].alias("followers"), p["connectionsCount"].alias("connections"),
        F.filter(F.transform(F.coalesce(p["skills"], F.array()), lambda s: has(s["name"])), lambda x: x.isNotNull()).alias("skills"),
        F.coalesce(p["experience"], F.array()).alias("experience"), F.coalesce(p["education"], F.array()).alias("education"),
    )


def parse_company_profile(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """A company's nested profile; industries are texts or objects with a name, specialties a list or a comma text."""
    c, has = F.col("_c"), S.blank_to_null
    first = F.get(c["industries"], F.lit(0))
    industry = F.when(F.size(c["industries"]) > 0, F.when(first.startswith("{"), F.coalesce(F.get_json_object(first, "$.name"), F.get_json_object(first, "$.title"))).otherwise(first)).otherwise(c["industry"])
    lo, hi = F.nullif(c["employeeCountRange"]["start"], F.lit(0)), F.nullif(c["employeeCountRange"]["end"], F.lit(0))
    size = F.when(hi.isNotNull(), F.concat(text_of(lo.cast("string")), F.lit("-"), hi)).when(lo.isNotNull(), F.concat(lo.cast("string"), F.lit("+"))).otherwise(F.coalesce(c["companySize"], c["staffCountRange"]))
    at, head = F.get(c["locations"], F.lit(0)), c["headquarter"]
    hq = F.coalesce(has(F.concat_ws(", ", has(at["city"]), F.coalesce(has(at["geographicArea"]), has(at["country"])))), has(F.concat_ws(", ", has(head["city"]), has(head["geographicArea"]), has(head["country"]))))
    spec = F.coalesce(has(c["specialities"]), has(c["specialties"]))
    return df.where(F.col(json).isNotNull()).withColumn("_c", F.from_json(json, FIRM)).select(
        key, F.coalesce(has(c["name"]), has(c["companyName"]), F.lit("")).alias("name"), has(F.regexp_replace(c["linkedinUrl"], "/+$", "")).alias("linkedin_url"), F.coalesce(c["universalName"], c["publicIdentifier"]).alias("public_id"),
        industry.alias("industry"), size.alias("company_size"), F.coalesce(c["employeeCount"], c["staffCount"]).alias("employee_count"), hq.alias("hq"), F.coalesce(c["foundedOn"]["year"].cast("string"), has(c["founded"])).alias("founded"),
        F.coalesce(has(c["website"]), has(c["websiteUrl"])).alias("website"), c["followerCount"].alias("followers"), F.when(spec.startswith("["), F.from_json(spec, "array<string>")).otherwise(S.split_list(spec, ",")).alias("specialties"), S.logo_url(c["logo"]).alias("logo_url"),
    )


def profile_roles(profiles: DataFrame, key: str) -> DataFrame:
    """One row per job: position in the profile (newest first), whether it is current, the company's name, address and logo."""
    end = F.lower(F.trim(text_of(F.col("e.endDate.text"))))
    url = S.company_url(F.regexp_replace(F.split_part("e.companyLinkedinUrl", F.lit("?"), F.lit(1)), "/+$", ""), "e.companyUniversalName", "e.companyId")
    return profiles.select(key, F.posexplode("experience").alias("pos", "e")).select(key, "pos", F.col("e.companyName").alias("company_name"), F.col("e.position").alias("title"), F.col("e.startDate.text").alias("start"), end.isin("", "present").alias("current"), url.alias("company_url"), S.logo_url("e.companyLogo").alias("company_logo"))


def profile_schools(profiles: DataFrame, key: str) -> DataFrame:
    return profiles.select(key, F.posexplode("education").alias("pos", "e")).select(key, "pos", F.col("e.schoolName").alias("school_name"), F.col("e.degree").alias("degree"), F.col("e.period").alias("period"))


def latest_stint(rows: DataFrame, person: str, target: str, *order: str) -> DataFrame:
    """The first row of each person and target in the profile's order."""
    n = F.row_number().over(Window.partitionBy(person, target).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def profile_edges(profiles: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(src, rel, dst, current): jobs at known companies (company_name, id) or at organisations made of the name's core, and
    schools. A target that a person has already is not taken again, jobs before schools."""
    jobs = profile_roles(profiles, key).join(known.select("company_name", F.col("id").alias("_id")).hint("merge"), "company_name", "left")
    org = F.when(S.is_org_name("company_name"), F.concat(F.lit("org|"), S.core_key("company_name")))
    works = jobs.select(F.col(key).alias("src"), F.lit("works_at").alias("rel"), F.coalesce("_id", org).alias("dst"), "current", F.lit(0).alias("kind"), "pos")
    school = F.when(S.is_org_name("school_name"), F.concat(F.lit("school|"), S.school_core("school_name")))
    studied = profile_schools(profiles, key).select(F.col(key).alias("src"), F.lit("studied_at").alias("rel"), school.alias("dst"), F.lit(None).cast("boolean").alias("current"), F.lit(1).alias("kind"), "pos")
    return latest_stint(works.unionByName(studied).where("dst IS NOT NULL"), "src", "dst", "kind", "pos").select("src", "rel", "dst", "current")


def rebuild_profile_edges(edges: DataFrame, made: DataFrame) -> DataFrame:
    """Edges of the people in `made` that come from no envelope are replaced; those of envelopes stay."""
    own = made.select("src").distinct().withColumn("_p", F.lit(True))
    old = edges.join(own.hint("merge"), "src", "left").where("_p IS NULL OR envelope_id IS NOT NULL OR rel NOT IN ('works_at', 'studied_at')").drop("_p")
    return old.unionByName(made.select("src", "rel", "dst", F.lit(None).cast("string").alias("envelope_id")))


def upgrade_names(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, canonical): a stub takes its profile's (id, name) longer name that holds it, unless another person has that name."""
    both = people.select("id", F.trim("canonical").alias("canonical")).join(profiles.select("id", F.col("name").alias("_name")), "id", "left")
    better = (F.col("canonical") != "") & (F.lower("canonical") != F.lower("_name")) & F.contains(F.lower("_name"), F.lower("canonical"))
    owner = people.groupBy(F.lower("canonical").alias("_low")).agg(F.min("id").alias("_owner"))
    out = both.join(owner, F.lower("_name") == F.col("_low"), "left")
    first = F.row_number().over(Window.partitionBy(F.lower("_name"), better & F.col("_owner").isNull()).orderBy("id")) == 1
    return out.withColumn("_first", first).select("id", F.when(better & F.col("_owner").isNull() & F.col("_first"), F.col("_name")).otherwise(F.col("canonical")).alias("canonical"))


def harvest_company_urls(companies: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, linkedin, logo, found): a company (id, linkedin, logo) without them takes the first role's (id, company_url)."""
    at = F.struct("person_id", "pos")
    best = roles.where("company_url IS NOT NULL").groupBy("id").agg(F.min_by("company_url", at).alias("_url"), F.min_by("company_logo", F.when(F.col("company_logo").isNotNull(), at)).alias("_logo"))
    return companies.join(best.hint("merge"), "id", "left").select("id", F.coalesce("linkedin", "_url").alias("linkedin"), F.coalesce("logo", "_logo").alias("logo"), (F.col("linkedin").isNull() & F.col("_url").isNotNull()).alias("found"))


def patch_founders(notes: DataFrame, people: DataFrame) -> DataFrame:
    """Notes (id, founders: name, linkedin) whose founders without an address take that of the person (person, linkedin)."""
    known = people.groupBy(F.lower("person").alias("_low")).agg(F.min("linkedin").alias("_url"))
    each = notes.select("id", F.posexplode("founders").alias("pos", "f")).withColumn("_low", F.lower("f.name")).join(known.hint("merge"), "_low", "left")
    one = F.struct("pos", F.col("f.name").alias("name"), F.coalesce("f.linkedin", "_url").alias("linkedin"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["name"], x["linkedin"])).alias("founders"))


def person_card(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """People (id, canonical, linkedin, email) with their profile (id, ...), if they have one."""
    p = profiles.withColumn("_has", F.lit(True)).withColumnRenamed("linkedin_url", "_url")
    out = people.join(p, "id", "left")
    return out.select("id", F.col("canonical").alias("person"), F.coalesce("_url", "linkedin").alias("linkedin"), "email", "headline", "current_title", "current_company", S.location_text("location_city", "location_country").alias("location"), "followers", F.coalesce("_has", F.lit(False)).alias("has_profile"))


def full_profile(entities: DataFrame, profiles: DataFrame, kind: str) -> DataFrame:
    """Profiles (id, ...) of one kind of entity (id, type, canonical) with its name as `entity_name`, every column of the
    profile under its own name; entities without a profile, and profiles of no such entity, are left out."""
    own = entities.where(F.col("type") == kind).select(F.col("id").alias("_id"), F.col("canonical").alias("entity_name"))
    return profiles.join(own.hint("merge"), F.col("id") == F.col("_id")).drop("_id")


def slug_groups(people: DataFrame) -> DataFrame:
    """(id, slug, size): people (id, linkedin) of one profile."""
    rows = people.select("id", S.profile_slug("linkedin").alias("slug")).where("slug IS NOT NULL")
    sizes = cut(rows.groupBy("slug").agg(F.count("*").alias("size")).where("size > 1"))
    return rows.join(sizes.hint("merge"), "slug").select("id", "slug", "size")
