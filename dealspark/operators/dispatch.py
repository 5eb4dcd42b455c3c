"""One pass over mixed raw items: each row's payload, a VARIANT, goes to the mapper of its source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What every mapper gives, in this order: the fields of one envelope before it is hashed and cleaned.
FIELDS = {
    "kind": "string", "thread": "string", "occurred_at": "timestamp", "title": "string", "sender": "string", "body_raw": "string",
    "labels": "array<string>", "has_attachment": "boolean", "headers": "array<struct<name:string,value:string>>", "label_ids": "array<string>", "basis": "string",
}
# Message types whose caption is the body, and those that are documents.
MEDIA = ("image", "video", "gif", "audio", "voice", "document", "sticker")
DOCUMENTS = ("document",)
# File types that are exported as text instead of being attachments.
NATIVE = ("application/vnd.google-apps.document", "application/vnd.google-apps.presentation", "application/vnd.google-apps.spreadsheet")
# Mail labels and what they are called here.
MAIL_LABELS = {"CATEGORY_PROMOTIONS": "newsletter", "CATEGORY_UPDATES": "newsletter", "CATEGORY_FORUMS": "newsletter", "Call Notes": "call-notes", "CallNotes": "call-notes"}


def field(payload: str, path: str, kind: str = "string") -> Column:
    """A value of the payload; null where the path is missing or has another type."""
    return F.try_variant_get(payload, f"${'' if path.startswith('[') else '.'}{path}", kind)


def full(*choices: Column) -> Column:
    """The first of the texts that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def made(**values) -> Column:
    """A mapper's result as a struct of FIELDS; what it doesn't give is null."""
    given = lambda k, t: (values[k] if isinstance(values[k], Column) else F.lit(values[k])) if k in values else F.lit(None)
    return F.struct(*[given(k, t).cast(t).alias(k) for k, t in FIELDS.items()])


def texts(*labels: str) -> Column:
    return F.array(*[F.lit(x) for x in labels]).cast("array<string>")


def chat(p: str) -> Column:
    """A message: its text or the caption of its medium; the content is the body, else the medium, else the message."""
    kind = F.coalesce(field(p, "type"), F.lit("text"))
    of_medium = lambda key: F.coalesce(*[F.when(kind == m, field(p, f"{m}.{key}")) for m in MEDIA])
    body, own = full(field(p, "text.body"), of_medium("caption")), F.coalesce(field(p, "from_me", "boolean"), F.lit(False))
    return made(
        kind="message", thread=field(p, "chat_id"), occurred_at=S.parse_ts(field(p, "timestamp")), title=field(p, "chat_name"), sender=field(p, "from"), body_raw=body,
        labels=F.when(own, texts("internal")).otherwise(texts("deal-flow")), has_attachment=kind.isin(*DOCUMENTS), basis=full(body, of_medium("sha256"), of_medium("id"), field(p, "id")),
    )


def mail(p: str, label_map: dict[str, str] = MAIL_LABELS) -> Column:
    """A mail with nested headers, or with headers flattened into the payload; labels are those given and those mapped."""
    headers = F.coalesce(field(p, "payload.headers", FIELDS["headers"]), F.array().cast(FIELDS["headers"]))
    flat = ("Subject", "From", "Date", "List-Unsubscribe", "List-Id", "Auto-Submitted", "Precedence")
    bare = F.filter(F.array(*[F.struct(F.lit(h).alias("name"), F.coalesce(field(p, f"['{h}']"), field(p, f"['{h.lower()}']")).alias("value")) for h in flat]), lambda h: h["value"].isNotNull())
    every = F.concat(headers, bare)
    header = lambda name: F.get(F.filter(every, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]
    body, ids = full(field(p, "text"), field(p, "body_text"), field(p, "snippet")), F.coalesce(field(p, "labelIds", "array<string>"), texts())
    mapped = F.filter(F.transform(ids, lambda x: S.lookup(x, label_map)), lambda x: x.isNotNull()) if label_map else texts()
    parts = F.coalesce(field(p, "payload.parts", "array<struct<filename:string>>"), F.array().cast("array<struct<filename:string>>"))
    at = F.coalesce(F.timestamp_millis(field(p, "internalDate", "bigint")), S.parse_ts(header("Date")))
    return made(
        kind="email", thread=field(p, "threadId"), occurred_at=at, title=header("Subject"), sender=header("From"), body_raw=body, headers=every, label_ids=ids,
        labels=F.array_distinct(F.concat(F.coalesce(field(p, "given_labels", "array<string>"), texts()), mapped)), has_attachment=F.exists(parts, lambda x: F.coalesce(x["filename"], F.lit("")) != ""),
        basis=F.concat(full(field(p, "id")), full(header("Subject")), F.substring(body, 1, 512)),
    )


def event(p: str, internal_domains: tuple[str, ...] = ()) -> Column:
    """A calendar event; external if anyone outside the internal domains takes part. Conference boilerplate goes."""
    start = F.coalesce(field(p, "start.dateTime"), field(p, "start.date"))
    guests = F.filter(F.transform(F.coalesce(field(p, "attendees", "array<struct<email:string>>"), F.array().cast("array<struct<email:string>>")), lambda a: a["email"]), lambda x: F.coalesce(x, F.lit("")) != "")
    outside = F.exists(guests, lambda x: ~S.is_internal_email(x, (*internal_domains, "resource.calendar.google.com")))
    return made(
        kind="event", thread=F.coalesce(field(p, "recurringEventId"), field(p, "id")), occurred_at=S.parse_ts(start), title=field(p, "summary"), sender=field(p, "organizer.email"),
        body_raw=F.trim(F.regexp_replace(full(field(p, "description")), r"(?s)-::~.*?~::-", "")), labels=F.concat(texts("calendar"), F.when(outside, texts("external-meeting")).otherwise(texts())),
        has_attachment=F.coalesce(F.size(field(p, "attachments", "array<variant>")), F.lit(0)) > 0, basis=F.concat(full(field(p, "id")), full(field(p, "updated"), start)),
    )


def file(p: str) -> Column:
    """A file of a drive: text if it can be exported, else an attachment; the content is its revision, checksum or time."""
    binary = ~F.coalesce(field(p, "mimeType"), F.lit("")).isin(*NATIVE)
    return made(
        kind=F.when(binary, "file").otherwise("document"), thread=field(p, "driveId"), occurred_at=S.parse_ts(field(p, "modifiedTime")), title=field(p, "name"), sender=field(p, "owners[0].emailAddress"),
        body_raw=full(field(p, "text"), field(p, "exportedText")), labels=texts("drive"), has_attachment=binary,
        basis=F.concat(full(field(p, "id")), full(field(p, "headRevisionId"), field(p, "md5Checksum"), field(p, "modifiedTime"))),
    )


def pdf(p: str) -> Column:
    name = F.nullif(full(field(p, "filename"), field(p, "title")), F.lit(""))
    return made(kind="file", occurred_at=S.parse_ts(field(p, "doc_date")), title=name, body_raw=full(field(p, "text")), labels=texts("pdf"), has_attachment=True, basis=full(field(p, "hash"), field(p, "filename"), F.to_json(p)))


def record(p: str) -> Column:
    """A structured record, by itself or under `record`; its body is its JSON with sorted keys."""
    own = F.coalesce(field(p, "record", "variant"), F.col(p))
    one = lambda *paths: F.nullif(full(*[F.try_variant_get(own, f"$.{x}", "string") for x in paths]), F.lit(""))
    return made(
        kind="record", thread=one("deal_id", "id"), occurred_at=S.parse_ts(one("updated_at", "created_at")), title=one("company", "name", "deal_name"), sender=one("deal_owner"),
        body_raw=F.to_json(own), labels=texts("dashboard", "internal"), has_attachment=False, basis=F.to_json(own),
    )


def generic(p: str) -> Column:
    """Any other source: a body, a text, or the whole payload as JSON."""
    body = full(field(p, "body"), field(p, "text"), F.to_json(p))
    return made(
        kind=F.coalesce(field(p, "kind"), F.lit("record")), thread=field(p, "thread_id"), occurred_at=S.parse_ts(field(p, "occurred_at")), title=field(p, "title"), sender=field(p, "from"), body_raw=body,
        labels=F.coalesce(field(p, "labels", "array<string>"), texts()), has_attachment=F.coalesce(F.size(field(p, "attachments", "array<variant>")), F.lit(0)) > 0, basis=body,
    )


#: The mapper of each source; all others are generic.
MAPPERS: dict[str, Callable[[str], Column]] = {"whatsapp": chat, "gmail": mail, "calendar": event, "drive_doc": file, "pdf": pdf, "dashboard": record}


def map_items(raw: DataFrame, mappers: dict[str, Callable[[str], Column]] = MAPPERS) -> DataFrame:
    """Envelopes of raw items (source, source_id, payload: JSON text or VARIANT) of any mix of sources, in one pass; the same
    for a batch and a stream. Other columns come along, but for those named like an envelope's.

    A payload that isn't JSON, or null, is a generic item whose body is its text; JSON that is no object has no fields, so
    it maps to an envelope without them. Null and unknown sources are generic."""
    kept = [c for c in raw.columns if c not in {"source", "source_id", "payload", "body_clean", "content_hash", "idempotency_key", *FIELDS}]
    text = raw.schema["payload"].dataType.simpleString() != "variant"
    if not raw.isStreaming:  # mapping is the work, however few files or row groups the rows lie in
        raw = raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = raw.withColumn("_p", F.try_parse_json("payload") if text else F.col("payload"))
    own = generic("_p")
    for source, mapper in reversed(mappers.items()):
        own = F.when(F.col("source") == source, mapper("_p")).otherwise(own)
    if text:
        lost = made(kind="record", body_raw=F.coalesce("payload", F.lit("")), labels=texts(), has_attachment=False, basis=F.coalesce("payload", F.lit("")))
        own = F.when(F.col("_p").isNull(), lost).otherwise(own)
    df = df.select(*kept, "source", F.col("source_id").cast("string").alias("source_id"), own.alias("_e")).select(*kept, "source", "source_id", "_e.*")
    df = df.withColumns({"body_clean": S.clean_body("body_raw"), "content_hash": F.sha2(F.coalesce("basis", F.lit("")), 256)}).drop("basis")
    return df.withColumn("idempotency_key", S.idem_key("source", "source_id", "content_hash"))
