"""Source mappers to one envelope, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from .checkpoints import cut

ENVELOPE = ["source", "source_id", "kind", "thread", "occurred_at", "title", "body_raw", "body_clean", "labels", "content_hash", "idempotency_key"]


def envelope(df: DataFrame, source: Column, source_id: Column, kind: str, thread: Column, at: Column, title: Column, body: Column, labels: Column, basis: Column) -> DataFrame:
    """The canonical row; basis is what makes two versions of an item the same content."""
    hash_ = F.sha2(F.coalesce(basis, F.lit("")), 256)
    return df.select(
        source.alias("source"), source_id.cast("string").alias("source_id"), F.lit(kind).alias("kind"), thread.cast("string").alias("thread"), at.alias("occurred_at"), title.cast("string").alias("title"),
        body.alias("body_raw"), S.clean_body(body).alias("body_clean"), labels.cast("array<string>").alias("labels"), hash_.alias("content_hash"), S.idem_key(source, source_id, hash_).alias("idempotency_key"),
    )


def map_chat(df: DataFrame) -> DataFrame:
    """(id, chat_id, ts, body, caption, media_sha, media_id, from_me): body or caption; the content is body, else media, else id."""
    body = F.coalesce(S.blank_to_null("body"), S.blank_to_null("caption"), F.lit(""))
    basis = F.coalesce(F.nullif(body, F.lit("")), "media_sha", "media_id", F.col("id").cast("string"))
    return envelope(df, F.lit("whatsapp"), F.col("id"), "message", F.col("chat_id"), S.parse_ts("ts"), F.lit(None), body, F.when(F.col("from_me"), F.array(F.lit("internal"))).otherwise(F.array()), basis)


def header(name: str, headers: str = "headers") -> Column:
    """The first header of this name, in any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def map_mail(df: DataFrame, label_map: dict[str, str] | None = None) -> DataFrame:
    """(id, thread_id, internal_date in ms, headers, label_ids, body, has_attachment)."""
    subject = F.coalesce(header("Subject"), F.lit(""))
    labels = S.map_labels(F.concat("label_ids", F.when(F.col("has_attachment"), F.array(F.lit("has-attachment"))).otherwise(F.array())), label_map or {})
    basis = F.concat(F.col("id").cast("string"), subject, F.substring(F.coalesce("body", F.lit("")), 1, 512))
    return envelope(df, F.lit("gmail"), F.col("id"), "email", F.col("thread_id"), F.timestamp_millis("internal_date"), subject, F.coalesce("body", F.lit("")), labels, basis)


def map_event(df: DataFrame, internal_domains: tuple[str, ...] = ()) -> DataFrame:
    """(id, updated, start, summary, description, attendees): external if any attendee is outside the internal domains."""
    outside = F.exists("attendees", lambda a: ~S.is_internal_email(a, internal_domains))
    body = F.regexp_replace(F.coalesce("description", F.lit("")), r"(?im)^.*(join (zoom|google meet|microsoft teams)|meeting id:|passcode:|dial-in).*$", "")
    return envelope(df, F.lit("calendar"), F.concat_ws("@", "id", "updated"), "event", F.col("id"), S.parse_ts("start"), F.col("summary"), body, F.when(outside, F.array(F.lit("external-meeting"))).otherwise(F.array()), F.concat("id", F.coalesce("updated", "start")))


def map_file(df: DataFrame) -> DataFrame:
    """(id, name, mime, revision, md5, modified, text): the content is the revision, else md5, else the time of change."""
    return envelope(df, F.lit("drive_doc"), F.col("id"), "file", F.col("id"), S.parse_ts("modified"), F.col("name"), F.coalesce("text", F.lit("")), F.when(F.col("mime").contains("google-apps"), F.array(F.lit("native"))).otherwise(F.array(F.lit("binary"))), F.concat("id", F.coalesce("revision", "md5", "modified")))


def map_document(df: DataFrame) -> DataFrame:
    """(source, doc_id, text)."""
    return envelope(df, F.col("source"), F.col("doc_id"), "document", F.col("doc_id"), F.lit(None).cast("timestamp"), F.lit(None), F.col("text"), F.array(), F.col("text"))


def map_record(df: DataFrame, ident: str, source: str = "crm") -> DataFrame:
    """Any row; its body is its JSON with the columns in order of name."""
    body = F.to_json(F.struct(*sorted(df.columns)))
    return envelope(df, F.lit(source), F.col(ident), "record", F.col(ident), F.lit(None).cast("timestamp"), F.lit(None), body, F.array(), body)


def map_generic(df: DataFrame) -> DataFrame:
    """(source, source_id, body) of unknown sources."""
    return envelope(df, F.col("source"), F.col("source_id"), "item", F.col("source_id"), F.lit(None).cast("timestamp"), F.lit(None), F.coalesce("body", F.lit("")), F.array(), F.coalesce("body", "source_id"))


def normalize(raw: DataFrame) -> DataFrame:
    """(source, source_id, body): chat rows by the chat mapper, all others by the generic one."""
    chat = raw.where("source = 'chat'").select(F.col("source_id").alias("id"), F.split_part("source_id", F.lit("-"), F.lit(1)).alias("chat_id"), F.lit(None).cast("string").alias("ts"), "body", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("media_sha"), F.lit(None).cast("string").alias("media_id"), F.lit(False).alias("from_me"))
    return map_chat(chat).unionByName(map_generic(raw.where("source IS NULL OR source <> 'chat'")))


def signal_score(rules: R.Rules = R.Rules(), source="source", title="title", body="body_clean", labels="labels", known: Column | None = None, attachment: Column | None = None) -> Column:
    """A prior by source, more for a known sender, deal terms and attachments, less for noise; call notes are at least 0.95."""
    known, attachment = F.lit(False) if known is None else known, F.lit(False) if attachment is None else attachment
    text = F.concat_ws("\n", title, body)
    has = lambda *xs: F.arrays_overlap(labels, F.array(*[F.lit(x) for x in xs]))
    s = F.coalesce(S.lookup(F.col(source), {k: str(v) for k, v in rules.priors.items()}).cast("double"), F.lit(0.3))
    s = s - F.when((F.col(source) == "calendar") & ~has("external-meeting"), 0.4).otherwise(0.0)
    s = s + F.when(known, 0.2).otherwise(0.0) + F.when(text.rlike(S.deal_pattern(rules.deal_terms)), 0.25).otherwise(0.0) + F.when(attachment, 0.2).otherwise(0.0)
    s = s - F.when(has("newsletter", "receipt"), 0.4).otherwise(0.0) - F.when((F.length(F.coalesce(body, F.lit(""))) < 20) & ~attachment, 0.3).otherwise(0.0)
    s = F.when(has("call-notes"), F.greatest(s, F.lit(0.95))).otherwise(s)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)


def apply_gate(df: DataFrame, threshold: float = 0.35) -> DataFrame:
    ok = F.col("signal_score") >= threshold
    return df.withColumn("status", F.when(ok, "normalized").otherwise("skipped")).withColumn("skip_reason", F.when(~ok, "low_signal"))


def classify_mail(df: DataFrame, rules: R.Rules = R.Rules(), mentions: Column | None = None, known: Column | None = None) -> DataFrame:
    """action, label and reason of mails (label_ids, headers, body); the first rule that fits decides."""
    known, mentions = F.lit(False) if known is None else known, F.lit(False) if mentions is None else mentions
    subject = F.trim(F.regexp_replace(F.coalesce(header("Subject"), F.lit("")), r"(?i)^\s*((re|fwd|fw|aw)\s*:\s*)+", ""))
    sender, text = F.lower(F.coalesce(header("From"), F.lit(""))), F.concat_ws("\n", subject, F.coalesce("body", F.lit("")))
    any_label = lambda xs: F.arrays_overlap("label_ids", F.array(*[F.lit(x) for x in xs])) if xs else F.lit(False)
    auto = F.lit(False)
    for x in R.AUTOMATED:
        auto = auto | sender.contains(x)
    out = lambda action, label, reason: F.struct(F.lit(action).alias("action"), F.lit(label).cast("string").alias("label"), F.lit(reason).alias("reason"))
    deal = text.rlike(R.DEAL_SUBJECT) | text.rlike(S.deal_pattern(rules.deal_terms))
    verdict = (
        F.when(any_label(rules.trusted_labels), out("index", "call-notes", "trusted_label"))
        .when((F.coalesce(header("List-Unsubscribe"), F.lit("")) != "") | (F.coalesce(header("List-Id"), F.lit("")) != ""), out("skip", None, "newsletter"))
        .when(~F.coalesce(header("Auto-Submitted"), F.lit("")).isin("", "no") | F.lower(F.coalesce(header("Precedence"), F.lit(""))).isin("bulk", "list", "junk") | auto, out("skip", None, "automated"))
        .when(any_label(R.BULK_LABELS), out("skip", None, "newsletter")).when(subject.rlike(R.SECURITY), out("skip", None, "confidential_security")).when(subject.rlike(R.FINANCE), out("skip", None, "confidential_finance"))
        .when(subject.rlike(R.HR), out("skip", None, "confidential_hr")).when(subject.rlike(R.CALL_NOTE), out("index", "call-notes", "subject_callnote")).when(deal, out("index", "deal-flow", "subject_deal"))
        .when(known, out("index", "deal-flow", "known_sender")).when(mentions, out("index", "deal-flow", "mention")).otherwise(out("skip", None, "low_signal"))
    )
    return df.withColumn("decision", verdict)


def redact(df: DataFrame, reason="reason", body="body_clean") -> DataFrame:
    secret = F.coalesce(F.col(reason).startswith("confidential"), F.lit(False))
    return df.withColumn(body, F.when(~secret, F.col(body))).withColumn("signal_score", F.when(secret, 0.0).otherwise(F.col("signal_score")))


def mentions(docs: DataFrame, spine: DataFrame, least: int = 4, small: int = 100_000) -> DataFrame:
    """(doc_id, id): documents whose text holds a spine name (id, canonical) of at least `least` characters, in any case.

    Up to `small` names (counted, and within `matching.MAX_CHARS`) are one broadcast automaton, and the texts are read once,
    without a shuffle. Beyond that a name is blocked by its first or last `least`, 8 or 16 characters (the most it has),
    whichever fewer names share, so that a common beginning is no hot key. The texts are read once for the windows that
    pass a filter of these keys (`windows`), so that only likely hits are shuffled; they meet the names on an equi join that
    carries ids but no text, and the texts are read once more to verify the candidates."""
    from . import matching, windows  # matching uses this module

    names = spine.where(F.length("canonical") >= least).select("id", F.lower("canonical").alias("name"))
    low = docs.select("doc_id", F.lower("text").alias("text")).where(F.length("text") >= least)
    few = matching.fetched_names(spine, "canonical", least, small)
    if few is not None:
        met = matching.with_names(low, "text", few).select("doc_id", F.explode("names").alias("name"))
        ids = F.broadcast(names) if names.count() <= small else names.hint("merge")
        return met.join(ids, "name").select("doc_id", "id").distinct()
    sizes = sorted({least, *(n for n in (8, 16) if n > least)})
    size = F.greatest(*[F.when(F.length("name") >= n, n).otherwise(least) for n in sizes]) if len(sizes) > 1 else F.lit(least)
    ends = cut(names.withColumn("size", size).select("id", "name", "size", F.explode(F.array(F.expr("substring(name, 1, size)"), F.expr("substring(name, length(name) - size + 1, size)"))).alias("key")))
    shared = ends.groupBy("key").agg(F.count("*").alias("n"))
    best = cut(ends.join(shared.hint("merge"), "key").groupBy("id", "name").agg(F.min_by("key", F.struct("n", "key")).alias("key")))
    seen = windows.key_windows(low, "doc_id", "text", windows.key_filter(best))
    met = cut(seen.join(best.hint("merge"), "key").select("doc_id", "id", "name"))
    pairs = met.join(low.hint("merge"), "doc_id")
    return pairs.where(F.contains("text", F.col("name"))).select("doc_id", "id").distinct()
