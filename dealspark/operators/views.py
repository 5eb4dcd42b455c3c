"""Views over entities, edges, envelopes and filings, and the lists that pages and notes read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from .numbering import numbered

KINDS = ("Financials", "Annual Return", "Charge", "Valuation", "Allotment/Capital", "Deposits")


def entity_view(entities: DataFrame, kind: str, attrs: dict[str, str]) -> DataFrame:
    """Entities (id, type, canonical, attrs MAP) of one type with typed attributes; what doesn't cast is null."""
    return entities.where(F.col("type") == kind).select("id", "canonical", *[F.try_element_at("attrs", F.lit(k)).try_cast(t).alias(k) for k, t in attrs.items()])


def email_log(envelopes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Indexed mails and decks with what brought them and their first attachment (the least hash), if any."""
    first = attachments.groupBy("envelope_id").agg(F.min_by("storage_ref", "hash").alias("deck_ref"))
    kind = (
        F.when(F.col("source") == "gmail", "Email").when(F.col("origin") == "drive", "Pitch deck (Drive)").when(F.col("origin") == "computer", "Pitch deck (uploaded)")
        .when(F.col("origin") == "email", "Pitch deck (email)").when(F.col("source_url").isNotNull(), "Pitch deck (Drive)").otherwise("Pitch deck (email)")
    )
    rows = envelopes.where("source IN ('gmail', 'pdf') AND status = 'indexed'")
    return rows.join(first, rows["id"] == first["envelope_id"], "left").select("id", F.date_format("occurred_at", "yyyy-MM-dd").alias("date"), "source", "title", kind.alias("kind"), "deck_ref")


def load_filings(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, about edges) of material filings; names (id, name) renames companies. Filings of kind Other are left out;
    of several with one name and day that of the least id is taken."""
    first = names.groupBy(F.col("id").alias("company_id")).agg(F.min("name").alias("_name"))
    df = rows.join(first, "company_id", "left").withColumn("company", F.coalesce("_name", S.blank_to_null("company_name")))
    df = df.withColumn("filing_kind", S.doc_kind("document_type", "name")).where(F.col("company").isNotNull() & F.col("filing_kind").isin(*KINDS))
    day = S.blank_to_null("filing_date")
    node = F.concat(F.col("company"), F.lit(" — "), F.coalesce(S.blank_to_null("name"), F.lit("Filing")), F.coalesce(F.concat(F.lit(" ("), day, F.lit(")")), F.lit("")))
    docs = df.select(node.alias("canonical"), "company", "filing_kind", day.alias("doc_date"), F.col("viewer_url").alias("source_url"), "registrar", F.col("id").alias("filing_id"))
    docs = docs.groupBy("canonical").agg(F.min_by(F.struct(*docs.columns[1:]), "filing_id").alias("d")).select("canonical", "d.*")
    return docs, docs.select(F.col("canonical").alias("src"), F.lit("about").alias("rel"), F.col("company").alias("dst"))


def company_documents(docs: DataFrame, about: DataFrame, companies: DataFrame) -> DataFrame:
    d = docs.join(about.where("rel = 'about'").select(F.col("src").alias("canonical"), F.col("dst").alias("_to")), "canonical")
    return d.join(companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("_to")), "_to").select("company_id", F.col("_to").alias("company"), F.col("filing_kind").alias("kind"), F.split_part("canonical", F.lit(" — "), F.lit(2)).alias("title"), F.col("doc_date").alias("filing_date"), "filing_id")


def recent_filings(docs: DataFrame, per_kind: int = 6) -> DataFrame:
    """The newest filings of each company and kind."""
    n = F.row_number().over(Window.partitionBy("company_id", "kind").orderBy(F.col("filing_date").desc_nulls_last(), "filing_id"))
    return docs.withColumn("n", n).where(F.col("n") <= per_kind)


def note_filings(docs: DataFrame, most: int = 40) -> DataFrame:
    """(company_id, n, kind, title, filing_date, filing_id, more): the newest `most` filings of each company, newest first, and
    how many more there are."""
    n = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("filing_date").desc_nulls_last(), "filing_id"))
    top = docs.withColumn("n", n).where(F.col("n") <= most)
    every = docs.groupBy("company_id").agg(F.count("*").alias("_all"))
    out = top.join(every.hint("merge"), "company_id")
    return out.select("company_id", "n", "kind", "title", "filing_date", "filing_id", F.greatest(F.col("_all") - most, F.lit(0)).alias("more"))


def summary_candidates(entities: DataFrame, edges: DataFrame, n: int, titles: int = 6) -> DataFrame:
    """The n most linked organisations (id, type, canonical, summary) without a summary, with up to six distinct role titles of
    edges (src, rel, dst, title). Titles are distinct before they are gathered, and cut to six by rank."""
    own = entities.where("type = 'org' AND coalesce(summary, '') = ''").select("id", "canonical")
    top = own.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree")), "id").orderBy(F.desc("degree"), "canonical", "id").limit(n)
    each = edges.where("rel = 'works_at' AND coalesce(title, '') <> ''").select(F.col("dst").alias("id"), "title").join(F.broadcast(top.select("id")), "id", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("title"))
    text = each.withColumn("_r", rank).where(F.col("_r") <= titles).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("title")), ", ").alias("context"))
    return top.join(text, "id", "left").withColumn("context", F.coalesce("context", F.lit("(none)")))


def referrers(companies: DataFrame, size: int = 1000) -> DataFrame:
    """(referrer, block, n, companies): who referred which companies (company, referrer), all of them in lists of `size` names
    numbered from 0; n counts all of a referrer."""
    rows = companies.where(S.blank_to_null("referrer").isNotNull()).select("referrer", "company").distinct()
    ranked = numbered(rows, ["referrer"], ["company"], "_n").withColumn("block", F.floor((F.col("_n") - 1) / size))
    lists = ranked.groupBy("referrer", "block").agg(F.array_sort(F.collect_list("company")).alias("companies"))
    return lists.join(rows.groupBy("referrer").agg(F.count("*").alias("n")), "referrer").select("referrer", "block", "n", "companies")


def sector_sizes(companies: DataFrame) -> DataFrame:
    return companies.where("sector IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n"))


def lookups(log: DataFrame, cap: int) -> DataFrame:
    """Look-ups (at) by day against the daily cap; 0: no cap."""
    return log.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n")).withColumn("remaining", F.greatest(F.lit(cap) - F.col("n"), F.lit(0)) if cap else F.lit(None).cast("long"))


def load_counts(companies: DataFrame, observations: DataFrame, links: DataFrame, bad: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(what, n) of a load; skipped: rows that were well formed but not wanted."""
    out = None
    for name, df in (("companies", companies), ("observations", observations), ("links", links), ("errors", bad), *([("skipped", skipped)] if skipped is not None else [])):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def list_people(cards: DataFrame) -> DataFrame:
    """Those with a profile first, by followers; placeholders are left out."""
    return cards.where(not_placeholder("person")).orderBy(F.desc("has_profile"), F.col("followers").desc_nulls_last(), "person", "id")


def not_placeholder(c) -> Column:
    """Whether a name isn't a stand-in for a person."""
    return ~S.col(c).rlike(R.PLACEHOLDER)


def owner_suggestions(tasks: DataFrame, staff: DataFrame) -> DataFrame:
    """Owners in use (owner) and staff (canonical), not blank."""
    return tasks.select(F.trim("owner").alias("owner")).unionByName(staff.select(F.trim("canonical").alias("owner"))).where("owner <> ''").distinct()


def flag_internal(people: DataFrame, works: DataFrame, home: str) -> DataFrame:
    own = works.where(F.col("dst") == home).select(F.col("src").alias("id")).distinct().withColumn("_in", F.lit(True))
    return people.join(own, "id", "left").withColumn("internal", F.coalesce("_in", F.lit(False))).drop("_in")


def canonicalize_names(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """notes (id, company_name) with `canonical`: the entity (id, canonical, aliases) of that name, else the first whose alias it is, else itself."""
    own = entities.select(F.lower("canonical").alias("_k"), F.lit(0).alias("p"), F.col("id").alias("e"), "canonical")
    alias = entities.select(F.explode("aliases").alias("a"), F.lit(1).alias("p"), F.col("id").alias("e"), "canonical").select(F.lower("a").alias("_k"), "p", "e", "canonical")
    best = own.unionByName(alias).groupBy("_k").agg(F.min_by("canonical", F.struct("p", "e")).alias("_c"))
    return notes.join(best.hint("merge"), F.lower("company_name") == F.col("_k"), "left").select("id", "company_name", F.coalesce("_c", "company_name").alias("canonical"))


def material_filings(rows: DataFrame) -> DataFrame:
    return rows.where(S.doc_kind("document_type", "name") != "Other")


def skip_empty(df: DataFrame, body: str = "body_clean") -> DataFrame:
    """Rows without text are skipped with their reason."""
    empty = S.blank_to_null(body).isNull()
    return df.withColumn("status", F.when(empty, "skipped").otherwise(F.col("status"))).withColumn("skip_reason", F.when(empty, "empty"))


def enrich_candidates(people: DataFrame, tried: DataFrame) -> DataFrame:
    """People (id, canonical, company, linkedin) to look up: well named, without an address, not tried; a single word needs a company."""
    single = F.size(F.split(F.trim("canonical"), r"\s+")) == 1
    return people.where(S.is_person_name("canonical") & F.col("linkedin").isNull() & ~(single & S.blank_to_null("company").isNull())).join(tried.select("id"), "id", "left_anti")


def resolve_meetings(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meetings, edges): events (id, title, organizer, attendees) as nodes; who organised and who attended, in lower case."""
    meetings = events.select(F.concat(F.lit("meeting|"), "id").alias("id"), F.lit("meeting").alias("type"), F.col("title").alias("canonical"))
    one = lambda rel, who: events.select(who.alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit("meeting|"), "id").alias("dst"))
    both = one("organized", F.lower("organizer")).unionByName(one("attended", F.explode(F.transform("attendees", F.lower))))
    return meetings, both.where(S.blank_to_null("src").isNotNull()).distinct()


def resolve_about(envelopes: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, rel, dst): a document is about the company (id, canonical) it names; its sender, if resolved, mentions it."""
    hit = envelopes.join(entities.select(F.col("id").alias("dst"), F.lower("canonical").alias("_k")), F.lower("company_name") == F.col("_k"))
    about = hit.select(F.concat(F.lit("doc|"), "id").alias("src"), F.lit("about").alias("rel"), "dst")
    return about.unionByName(hit.where("sender_id IS NOT NULL").select(F.col("sender_id").alias("src"), F.lit("mentions").alias("rel"), "dst")).distinct()


def caption_chunks(df: DataFrame, key: str, max_pages: int = 40) -> DataFrame:
    """Captions (array of page, text; n_pages) as chunks: a page outside the document is null, blank texts go."""
    rows = df.select(key, "n_pages", F.posexplode(F.slice("captions", 1, max_pages)).alias("seq", "c"))
    page = F.col("c.page").try_cast("int")
    return rows.where(S.blank_to_null("c.text").isNotNull()).select(key, "seq", F.when(page.between(1, F.col("n_pages")), page).alias("page"), F.trim("c.text").alias("chunk"))


def coerce_note(c, name: str = "company_name") -> tuple[Column, Column]:
    """(note, also_mentioned) of a model's answer: an object, or the first object of an array and the names of the others."""
    s = F.trim(S.col(c))
    items = F.when(s.startswith("["), F.from_json(s, "array<string>")).otherwise(F.array(s))
    items = F.filter(items, lambda x: F.trim(x).startswith("{"))
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    return F.get(items, F.lit(0)), F.filter(F.transform(rest, lambda x: F.get_json_object(x, f"$.{name}")), lambda x: x.isNotNull())


def index_exports(card: DataFrame, people: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """companies, deals (an ask or a round), pipeline (the others), people by name, and log, each mail or deck with its type
    of meeting; ready for a JSON sink. A card without the flag has no deal.

    people: (canonical, role, company, linkedin); log: (file, date, company, source)."""
    rows, deal = card.withColumn("sectors", S.sectors_of("sector")), F.coalesce("has_deal", F.lit(False))
    kept = ["company_name", "sectors", *[c for c in ("stage", "max_revenue", "max_valuation", "ask", "last_interaction") if c in card.columns]]
    return {
        "companies": rows.select(kept), "deals": rows.where(deal).select(kept), "pipeline": rows.where(~deal).select(kept),
        "people": people.select(F.col("canonical").alias("name"), "role", "company", "linkedin"),
        "log": log.select("file", "date", "company", F.when(F.col("source") == "pdf", "Deck").otherwise("Call").alias("meeting_type")),
    }


def records(envelopes: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, company, label): what each envelope (id, company_name, kind) records: a deck, or a call with an investor or a
    founder by the type of the company (canonical, sector, summary) it names."""
    kinds = companies.select(F.lower("canonical").alias("_k"), S.entity_type("sector", "canonical", "summary").alias("_type")).groupBy("_k").agg(F.min("_type").alias("_type"))
    out = envelopes.join(kinds.hint("merge"), F.lower("company_name") == F.col("_k"), "left")
    return out.select("id", F.col("company_name").alias("company"), S.meeting_type("kind", F.coalesce("_type", F.lit("company"))).alias("label"), S.type_category("_type").alias("category"))
