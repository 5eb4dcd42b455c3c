"""Scalar rules as Column to Column functions; all run inside the JVM and give null for null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def variants(groups: dict[str, list[str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, others in groups.items():
        out |= {name.lower(): name} | {v: name for v in others}
    return out


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def clean_body(c) -> Column:
    """Mail text without forwarding marks, forwarder promotions, header lines, quotes, signature and surplus space; null: ''."""
    text = F.coalesce(col(c), F.lit(""))
    for pattern, to in (
        (r"(?im)^\s*-{2,}\s*Forwarded message\s*-{2,}\s*$", ""),
        (r"(?im)^.*(cloudhq|multi[- ]?email[- ]?forward|emails-to-sheets|export emails to google sheets|export, backup, and parse|labels and documents|you might be also interested|gmail\s*<https?://).*$", ""),
        (r"(?im)^\s*(Date Received|Date Sent|From|To|Cc|Bcc|Sent|Date|Subject|Reply-To|Importance|Message-ID):.*$", ""),
        (r"(?m)^\s*(>|On .{0,80} wrote:).*", ""),
        (r"(?s)\n-- ?\n.*$", ""),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_ts(c) -> Column:
    """Epoch seconds or ISO text to a timestamp, else null."""
    s = col(c).cast("string")
    return F.coalesce(F.timestamp_seconds(F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s).cast("double")), F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-"), s)))


def sha_key(*parts) -> Column:
    """sha256 of the parts joined by |; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def idem_key(source, source_id, content_hash) -> Column:
    return sha_key(source, source_id, content_hash)


def map_labels(labels, table: dict[str, str]) -> Column:
    """Each label by its mapped name, or itself; order kept, repeats dropped."""
    return F.array_distinct(F.transform(col(labels), lambda x: F.coalesce(lookup(x, table), x) if table else x))


def gb_num(c) -> Column:
    """The whole text as a number, or null."""
    return col(c).cast("string").try_cast("decimal(20,4)")


def safe_num(c) -> Column:
    """The first number of a text; an amount in millions or billions counts 8.5 or 8500 crore per unit."""
    s = F.regexp_replace(F.trim(col(c).cast("string")), ",", "")
    pattern = r"(?i)\$?\s*(\d+(?:\.\d+)?)\s*([mb])\b"
    n, unit = F.regexp_extract(s, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(s, pattern, 2))
    plain = F.regexp_extract(s, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(unit == "m", F.round(n * 8.5, 4)).when(unit == "b", F.round(n * 8500, 4)).otherwise(plain)


def num_or_null(c) -> Column:
    return F.nullif(col(c).cast("string"), F.lit("")).try_cast("double")


def canon_sector(c, table: dict[str, list[str]] = R.SECTORS) -> Column:
    key = blank_to_null(c)
    return F.coalesce(lookup(F.lower(key), variants(table)), key)


def canon_stage(c) -> Column:
    return canon_sector(c, R.STAGES)


def sectors_of(c) -> Column:
    """A text of several sectors as the distinct canonical ones, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[,/]| and "), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: canon_sector(x)))


def entity_type(sector, name, summary) -> Column:
    t = F.lower(F.concat_ws(" ", *[F.coalesce(col(x), F.lit("")) for x in (sector, name, summary)]))
    any_of = lambda *words: t.rlike("|".join(words))
    return (
        F.when(any_of("venture debt", "private credit"), "vd").when(any_of("private equity"), "pe").when(any_of("asset management", "asset manager"), "am")
        .when(any_of("venture capital", r"\bvc\b", "micro-vc"), "vc").when(any_of("law firm", "legal counsel", "law offices"), "lawfirm")
        .when(any_of("investment bank", "merchant bank") | (t.contains("advisory") & ~t.contains("fund")), "ib").otherwise("company")
    )


def is_investor_type(c) -> Column:
    return col(c).isin("vc", "pe", "vd", "am")


def type_category(c) -> Column:
    return lookup(col(c), {"vc": "Venture Capital", "pe": "Private Equity", "vd": "Venture Debt", "am": "Asset Management", "ib": "Investment Banking", "lawfirm": "Law Firm"})


def make_aliases(c) -> Column:
    """The name without its legal and industry words, and an acronym of two to six letters."""
    name = col(c)
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    core = F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"^[.,&]+|[.,&]+$", "").isin(*R.ALIAS_SUFFIX))
    short = F.when((F.size(core) > 0) & (F.size(core) < F.size(words)), F.array_join(core, " "))
    letters = F.upper(F.array_join(F.transform(F.filter(core, lambda w: w.rlike(r"^[\p{L}\p{N}]")), lambda w: F.substring(w, 1, 1)), ""))
    acronym = F.when((F.size(core) >= 2) & F.length(letters).between(2, 6), letters)
    found = F.filter(F.array(short, acronym), lambda x: x.isNotNull() & (F.lower(x) != F.lower(name)))
    return F.when(F.size(found) == 2, F.when(F.lower(found[0]) == F.lower(found[1]), F.slice(found, 1, 1)).otherwise(found)).otherwise(found)


def email_of(c) -> Column:
    return F.lower(F.nullif(F.regexp_extract(col(c), r"[\w.+-]+@[\w-]+\.[\w.-]+", 0), F.lit("")))


def name_from_email(c) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.split_part(col(c), F.lit("@"), F.lit(1)), r"[._-]+", " ")))


def is_internal_email(c, domains: Iterable[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | F.endswith(F.lower(col(c)), F.lit("@" + d.lower()))
    return F.coalesce(out, F.lit(False))


def parse_contacts(c) -> Column:
    """'Name <address>, ...' as structs (name, email); a comma in quotes does not part contacts."""
    parts = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r'((?:"[^"]*"|[^,"])+)'), F.lit(1))
    email = lambda x: F.lower(F.regexp_extract(x, r"([^\s<>,\"]+@[^\s<>,\"]+)", 1))
    name = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"<[^>]*>", "")), r'^["\s]+|["\s]+$', "")
    made = F.transform(parts, lambda x: F.struct(F.when(~name(x).contains("@"), name(x)).otherwise("").alias("name"), email(x).alias("email")))
    return F.filter(made, lambda x: x["email"] != "")


def is_person_name(c) -> Column:
    n = F.trim(F.coalesce(col(c), F.lit("")))
    tokens = F.filter(F.split(F.lower(n), r"[\s.\-]+"), lambda t: t != "")
    return (F.length(n) >= 3) & n.rlike(r"^[A-Za-z][A-Za-z.'\- ]+$") & ~F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in R.ROLE_WORDS]))


def _bare(c) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"^\.+|\.+$", "")


def is_investor_name(c) -> Column:
    n = _bare(c)
    return (F.length(n) >= 2) & ~n.contains("@") & ~F.lower(n).isin(*R.NO_INVESTOR) & ~n.rlike(R.GENERIC_INVESTOR)


def is_org_name(c) -> Column:
    n = _bare(c)
    return (F.length(n) >= 2) & ~n.contains("@") & ~F.lower(n).isin(*R.NO_ORG)


def is_company_name(c) -> Column:
    n = F.trim(F.coalesce(col(c), F.lit("")))
    return (F.length(n) >= 3) & ~F.lower(n).isin(*R.NO_COMPANY)


def norm_co(c) -> Column:
    """A company name's core: lower case, no marks, no legal or industry words."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, R.CORE_SUFFIX, " "), r"\s+", " "))


def core_key(c) -> Column:
    return F.regexp_replace(norm_co(c), " ", "")


def investor_core(c) -> Column:
    """The company core without words of funds and places."""
    return F.regexp_replace(F.regexp_replace(norm_co(c), R.INVESTOR_EXTRA, " "), " ", "")


def school_core(c) -> Column:
    """The company core without words of schools."""
    return F.regexp_replace(F.regexp_replace(norm_co(c), R.SCHOOL_EXTRA, " "), " ", "")


def norm_profile_url(c, site: str = "linkedin.com") -> Column:
    """A profile address without query, fragment and closing slashes, always under www."""
    u = F.regexp_replace(F.split_part(F.split_part(F.trim(col(c)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")
    return F.regexp_replace(u, rf"(?i)^https?://(?:[a-z]{{2,3}}\.)?{re.escape(site)}", f"https://www.{site}")


def profile_slug(c, kind: str = "in") -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(col(c), rf"(?i)/{kind}/([^/?#]+)", 1)), "/+$", ""), F.lit(""))


def slug_key(c, kind: str = "in") -> Column:
    return F.regexp_replace(profile_slug(c, kind), "[^a-z0-9]", "")


def slug_matches_name(url, name, kind: str = "in", least: int = 3) -> Column:
    """Whether the slug holds a token of the name; a company name without a long token is taken on trust."""
    keep = "[^a-z]" if kind == "in" else "[^a-z0-9]"
    slug = F.regexp_replace(profile_slug(url, kind), keep, "")
    tokens = F.filter(F.split(F.lower(F.coalesce(col(name), F.lit(""))), r"[\s.]+"), lambda t: F.length(t) >= least)
    tokens = tokens if kind == "in" else F.transform(tokens, lambda t: F.regexp_replace(t, keep, ""))
    hit = F.exists(tokens, lambda t: (t != "") & F.contains(slug, t))
    return F.coalesce(F.when(F.size(tokens) == 0, F.lit(kind != "in") & slug.isNotNull()).otherwise(hit), F.lit(False))


def web_key(c) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "/+$", ""), r"^https?://(www\.)?", ""), F.lit(""))


def domain_of(c) -> Column:
    host = F.regexp_extract(F.lower(F.trim(col(c))), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def safe_name(c) -> Column:
    """A file name: no illegal characters, at most 120 characters (longer ones end in a hash), never empty."""
    n = F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r'[/\\:*?"<>|#^\[\]]', "-")
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, "\n", " "), r"\s{2,}", " "), r"^[ .\-]+|[ .\-]+$", "")
    cut = F.concat(F.rtrim(F.substring(n, 1, 108)), F.lit("-"), F.substring(F.sha1(n.cast("binary")), 1, 6))
    return F.when(n == "", "Untitled").when(F.length(n) > 120, cut).otherwise(n)


def slug_id(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(safe_name(c)), r"[\s_.]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def fy_period(c) -> Column:
    return F.when(col(c).rlike(r"^\d{4}"), F.concat(F.lit("FY"), F.substring(col(c), 3, 2)))


def primary_sector(c) -> Column:
    return canon_sector(F.split_part(col(c), F.lit(">"), F.lit(1)))


def split_list(c, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def parse_person(c) -> Column:
    """'Name (Role)' as a struct; without brackets the role is null."""
    m = r"^(.*?)\s*\((.*)\)\s*$"
    has = col(c).rlike(m)
    return F.struct(F.when(has, F.regexp_extract(col(c), m, 1)).otherwise(F.trim(col(c))).alias("name"), F.when(has, F.regexp_extract(col(c), m, 2)).alias("role"))


def doc_kind(document_type, name) -> Column:
    t, n = F.coalesce(col(document_type), F.lit("")), F.lower(F.coalesce(col(name), F.lit("")))
    has = lambda *xs: n.rlike("|".join(xs))
    return (
        F.when((t == "Financial Documents") | has("aoc-4", "financial statement", "balance sheet"), "Financials").when((t == "Annual Reports") | has("mgt-7", "annual return"), "Annual Return")
        .when((t == "Charge Documents") | has("chg-"), "Charge").when((t == "Valuation Documents") | has("valuation"), "Valuation")
        .when(has("pas-3", "allottees") | (t == "Changes to Capital Structure"), "Allotment/Capital").when(has("dpt-3"), "Deposits").otherwise("Other")
    )


def usd_m_to_cr(c) -> Column:
    return F.round(col(c) * R.USD_M_TO_CRORE, 2)


def fmt_cr(c) -> Column:
    return F.concat(F.lit("₹"), F.regexp_replace(F.format_string("%.2f", col(c).cast("double")), r"\.?0+$", ""), F.lit(" Cr"))


def llm_usd(model, tokens_in, tokens_out, prices: dict[str, tuple[float, float]] = R.PRICES) -> Column:
    one = lambda i: lookup(col(model), {k: str(v[i]) for k, v in prices.items()}).cast("double")
    return F.round((col(tokens_in) * one(0) + col(tokens_out) * one(1)) / 1e6, 5)


def cite(title, kind, page) -> Column:
    return F.concat_ws(" — ", col(title), F.when(col(page).isNotNull(), F.concat(F.initcap(col(kind)), F.lit(" p."), col(page).cast("string"))).otherwise(F.initcap(col(kind))))


def token_est(c) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("int")


def source_kind(origin, source, has_attachment) -> Column:
    return F.when(col(origin).isNotNull(), col(origin)).when(col(has_attachment), "deck").when(col(source) == "gmail", "email").otherwise(col(source))


def location_text(*parts) -> Column:
    return F.nullif(F.concat_ws(", ", *[blank_to_null(p) for p in parts]), F.lit(""))


def company_url(url, slug, company_id, site: str = "https://www.linkedin.com/company/") -> Column:
    return F.coalesce(blank_to_null(url), F.concat(F.lit(site), blank_to_null(slug)), F.concat(F.lit(site), blank_to_null(company_id)))


def logo_url(c) -> Column:
    """A logo given as an address or as an object that has one."""
    s = F.trim(col(c))
    return F.when(s.startswith("{"), F.get_json_object(s, "$.url")).when(s.startswith("http"), s)


def meeting_type(kind, company_type) -> Column:
    return F.when(col(kind) == "deck", "Deck").when(is_investor_type(company_type), "VC").otherwise("Founder")


def html_to_text(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def parse_share_url(c) -> Column:
    """(kind, id) of a share address: the first rule that fits."""
    u, ident = F.trim(F.coalesce(col(c), F.lit(""))), r"([A-Za-z0-9_-]{20,})"
    found = F.lit(None).cast("struct<kind:string,id:string>")
    for pattern, kind in reversed(((r"/presentation/d/", "slides"), (r"/document/d/", "docs"), (r"/spreadsheets/d/", "sheet"), (r"/file/d/", "file"), (r"/(?:drive/)?folders/", "folder"), (r"[?&]id=", "file"))):
        found = F.when(u.rlike(pattern + ident), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(u, pattern + ident, 1).alias("id"))).otherwise(found)
    return found


def deal_pattern(terms: Iterable[str] = R.DEAL_TERMS) -> str:
    return r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"


def collect_ids(c, length: int = 24) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(rf'"id"\s*:\s*"([^"]{{{length}}})"'), F.lit(1)))


def salvage_json(c, schema: str) -> Column:
    """The object in a model's answer: without code fences, else the outermost braces, else a stub of low confidence."""
    bare = F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.from_json(F.coalesce(ok(F.when(bare.startswith("{"), bare)), ok(F.when(inner != "", inner)), F.lit('{"confidence": "low"}')), schema)
