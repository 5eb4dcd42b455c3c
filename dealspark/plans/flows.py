"""Registered queries of mixed flows and of streams with state, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import checkpoints, dispatch, matching
from ..sources.publish import published
from ..streaming import stateful, streams
from .derived import Tables
from .landing import obj
from .registry import query

# Mixed raw items ----------------------------------------------------------------------------------------------------
#: conversations as messages, captions, mails, events and records by (conv_id + turn) % 5; documents as exported and binary
#: files, PDFs and items of their own sources by doc_id % 4.
MIXED = r"""
WITH c AS (SELECT *, conv_id || '-' || turn AS id, (conv_id + turn) % 5 AS k, turn % 2 = 0 AS even FROM conversations),
e AS (
  SELECT 'whatsapp' AS source, id AS source_id, 'message' AS kind, CAST(conv_id AS VARCHAR) AS thread, CAST(NULL AS VARCHAR) AS title, CASE WHEN even THEN 'internal' ELSE 'deal-flow' END AS labels, false AS has_attachment, coalesce(nullif(text, ''), id) AS basis FROM c WHERE k = 0
  UNION ALL SELECT 'whatsapp', id, 'message', CAST(conv_id AS VARCHAR), NULL, 'deal-flow', k = 1 AND even, coalesce(nullif(text, ''), 'sha' || id) FROM c WHERE k = 1
  UNION ALL SELECT 'gmail', id, 'email', CAST(conv_id AS VARCHAR), 'Re: ' || role, CASE WHEN even THEN 'newsletter' ELSE '' END, NOT even, id || 'Re: ' || role || substr(coalesce(text, ''), 1, 512) FROM c WHERE k = 2
  UNION ALL SELECT 'calendar', id, 'event', id, role, CASE WHEN even THEN 'calendar' ELSE 'calendar,external-meeting' END, false, id || '2024-01-01T10:00:00' FROM c WHERE k = 3
  UNION ALL SELECT 'dashboard', id, 'record', CAST(conv_id AS VARCHAR), role, 'dashboard,internal', false, '{"company":"' || role || '","deal_id":' || conv_id || ',"turn":' || turn || '}' FROM c WHERE k = 4
  UNION ALL SELECT CASE doc_id % 4 WHEN 2 THEN 'pdf' WHEN 3 THEN source ELSE 'drive_doc' END, CAST(doc_id AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 3 THEN 'record' ELSE 'file' END, NULL,
    CASE WHEN doc_id % 4 < 3 THEN 'f' || doc_id END, CASE WHEN doc_id % 4 < 2 THEN 'drive' WHEN doc_id % 4 = 2 THEN 'pdf' ELSE lang END, doc_id % 4 IN (1, 2),
    CASE WHEN doc_id % 4 = 0 THEN doc_id || 'r1' WHEN doc_id % 4 = 1 THEN doc_id || 'm1' WHEN doc_id % 4 = 2 THEN 'h' || doc_id ELSE coalesce(nullif(text, ''), '{"body":"","labels":["' || lang || '"]}') END FROM documents)
SELECT source, source_id, kind, thread, title, labels, has_attachment, sha256(basis) AS content_hash FROM e
"""


def chats(rows: DataFrame) -> DataFrame:
    """(source, source_id, payload) of conversations; for a batch or a stream."""
    ident, k, even = F.concat_ws("-", "conv_id", "turn"), (F.col("conv_id") + F.col("turn")) % 5, F.col("turn") % 2 == 0
    thread, text = F.col("conv_id").cast("string"), F.col("text")
    message = obj(id=ident, chat_id=thread, type=F.lit("text"), text=obj(body=text), timestamp=F.lit(1_700_000_000) + F.col("turn"), from_me=even)
    caption = obj(id=ident, chat_id=thread, type=F.when(even, "document").otherwise("image"), document=F.when(even, obj(caption=text, sha256=F.concat(F.lit("sha"), ident))), image=F.when(~even, obj(caption=text, sha256=F.concat(F.lit("sha"), ident))))
    name = lambda n, v: obj(name=n, value=v)
    mail = obj(id=ident, threadId=thread, internalDate=F.lit("1700000000000"), labelIds=F.when(even, F.array(F.lit("CATEGORY_UPDATES"), F.lit("X"))), snippet=text, payload=obj(headers=F.array(name("SUBJECT", F.concat(F.lit("Re: "), "role")), name("From", F.lit("a@x.org"))), parts=F.when(~even, F.array(obj(filename="a.pdf")))))
    guests = F.when(even, F.array(obj(email="a@own.org"))).otherwise(F.array(obj(email="a@own.org"), obj(email="b@x.org")))
    meeting = obj(id=ident, summary=F.col("role"), start=obj(dateTime="2024-01-01T10:00:00"), attendees=guests, description=text)
    deal = obj(record=obj(turn=F.col("turn"), deal_id=F.col("conv_id"), company=F.col("role")))
    source = F.element_at(F.array(*[F.lit(x) for x in ("whatsapp", "whatsapp", "gmail", "calendar", "dashboard")]), (k + 1).cast("int"))
    json = F.when(k == 0, F.to_json(message)).when(k == 1, F.to_json(caption)).when(k == 2, F.to_json(mail)).when(k == 3, F.to_json(meeting)).otherwise(F.to_json(deal))
    return rows.select(source.alias("source"), ident.alias("source_id"), json.alias("payload"))


def papers(rows: DataFrame) -> DataFrame:
    """(source, source_id, payload) of documents."""
    k, ident, name = F.col("doc_id") % 4, F.col("doc_id").cast("string"), F.concat(F.lit("f"), "doc_id")
    native = obj(id=ident, mimeType="application/vnd.google-apps.document", name=name, headRevisionId="r1", md5Checksum="m1", text=F.col("text"))
    binary = obj(id=ident, mimeType="application/pdf", name=name, md5Checksum="m1")
    source = F.when(k == 2, "pdf").when(k == 3, F.col("source")).otherwise("drive_doc")
    json = F.when(k == 0, F.to_json(native)).when(k == 1, F.to_json(binary)).when(k == 2, F.to_json(obj(filename=name, hash=F.concat(F.lit("h"), "doc_id"), text=F.col("text")))).otherwise(F.to_json(obj(body=F.col("text"), labels=F.array("lang"))))
    return rows.select(source.alias("source"), ident.alias("source_id"), json.alias("payload"))


#: The library's mappers, with the home domain of these rows.
MAPPERS = dispatch.MAPPERS | {"calendar": lambda p: dispatch.event(p, ("own.org",))}


def mapped(raw: DataFrame) -> DataFrame:
    return dispatch.map_items(raw, MAPPERS).select("source", "source_id", "kind", "thread", "title", F.array_join("labels", ",").alias("labels"), "has_attachment", "content_hash")


@query(MIXED)
def envelopes_mixed(t):
    """Every row of both tables by the mapper of its source, in one pass over the mixed rows."""
    return mapped(chats(t.conversations).unionByName(papers(t.documents)))


def stream_of(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.dir}/{name}.parquet*")


def drained(t: Tables, df: DataFrame) -> DataFrame:
    """All the stream has now, as a table in the shared folder."""
    home = checkpoints.folder(t.spark)
    streams.run_available(df, f"{home}/out", f"{home}/log")
    return t.spark.read.schema(df.schema).parquet(f"{home}/out")


@query(MIXED)
def stream_mixed(t):
    """The same rows as streams."""
    return drained(t, mapped(chats(stream_of(t, "conversations")).unionByName(papers(stream_of(t, "documents")))))


# Decisions ----------------------------------------------------------------------------------------------------------
# Subjects, senders, labels and headers of mails by (conv_id * 5 + turn) % 13.
SUBJECTS = ("Weekly", "Weekly", "Weekly", "Weekly", "Weekly", "Re: Your OTP is here", "Payslip for May", "Fwd: Offer letter", "RE: fw: Meeting notes", "Our pitch", "Hello", "About ", "Hello")
OUTCOMES = ("trusted_label", "newsletter", "automated", "newsletter", "automated", "confidential_security", "confidential_finance", "confidential_hr", "subject_callnote", "subject_deal")


def words(pattern: str) -> str:
    return pattern.replace("'", "''")


DECIDED = f"""
WITH m AS (SELECT *, conv_id || '-' || turn AS id, (conv_id * 5 + turn) % 13 AS k, conv_id % 100 + 1 AS about FROM conversations),
b AS (SELECT *, regexp_matches(text, '{words(R.DEAL_SUBJECT)}') OR regexp_matches(text, '(?i)\\b({"|".join(words(x) for x in R.DEAL_TERMS)})\\b') AS deal FROM m),
r AS (SELECT id, length(text) > 0 AS has_text, CASE WHEN k < 10 THEN {list(OUTCOMES)}[k + 1] WHEN deal THEN 'subject_deal' WHEN k = 10 AND conv_id % 2 = 0 THEN 'known_sender' WHEN k = 11 THEN 'mention' ELSE 'low_signal' END AS reason FROM b)
SELECT id AS source_id, reason, CASE WHEN reason IN ('trusted_label', 'subject_callnote') THEN 'call-notes' WHEN reason IN ('subject_deal', 'known_sender', 'mention') THEN 'deal-flow' ELSE '' END AS label,
  CASE WHEN reason IN ('trusted_label', 'subject_callnote', 'subject_deal', 'known_sender', 'mention') THEN 'normalized' ELSE 'skipped' END AS status, has_text AND NOT starts_with(reason, 'confidential') AS body_kept FROM r
"""


def mails(rows: DataFrame) -> DataFrame:
    """(source, source_id, payload): each turn of a conversation as a mail."""
    k, ident = (F.col("conv_id") * 5 + F.col("turn")) % 13, F.concat_ws("-", "conv_id", "turn")
    subject = F.element_at(F.array(*[F.lit(x) for x in SUBJECTS]), (k + 1).cast("int"))
    subject = F.when(k == 11, F.concat(subject, F.lit("CUSTOMER#"), F.lpad((F.col("conv_id") % 100 + 1).cast("string"), 9, "0"))).otherwise(subject)
    sender = F.when(k == 2, "No-Reply@x.org").when(k == 10, F.concat(F.lit("Ann <Person"), F.col("conv_id") % 50, F.lit("@Firm.com>"))).otherwise("a@x.org")
    head = lambda n, v: obj(name=n, value=v)
    extra = F.when(k == 1, F.array(head("List-Unsubscribe", F.lit("<mailto:x>")))).when(k == 4, F.array(head("precedence", F.lit("Bulk")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    labels = F.when(k == 0, F.array(F.lit("L1"))).when(k == 3, F.array(F.lit("SPAM"))).otherwise(F.array().cast("array<string>"))
    payload = obj(id=ident, labelIds=labels, text=F.col("text"), payload=obj(headers=F.concat(F.array(head("Subject", subject), head("From", sender)), extra)))
    return rows.select(F.lit("gmail").alias("source"), ident.alias("source_id"), F.to_json(payload).alias("payload"))


def decided(t: Tables, rows: DataFrame) -> DataFrame:
    """Known senders are the even ones of fifty; the spine's names are all customers'."""
    senders = t.conversations.where("conv_id % 2 = 0").select(F.concat(F.lit("person"), F.col("conv_id") % 50, F.lit("@firm.com")).alias("key")).distinct()
    out = matching.decide(dispatch.map_items(mails(rows)), senders, t.customer.select(F.col("c_name").alias("canonical")), R.Rules(trusted_labels=("L1",)))
    return out.select("source_id", "reason", F.array_join("labels", ",").alias("label"), "status", (F.length(F.coalesce("body_raw", F.lit(""))) > 0).alias("body_kept"))


@query(DECIDED)
def mail_decisions(t):
    """All eleven reasons, known senders by a join and mentions by one automaton of all customers."""
    return decided(t, t.conversations)


@query(DECIDED)
def stream_decisions(t):
    """The same rows as a stream, whose micro-batches are decided as batches, so that the spine may have any number of names."""
    home = checkpoints.folder(t.spark)
    streams.run_batches(stream_of(t, "conversations"), lambda batch: decided(Tables(batch.sparkSession, t.dir), batch), f"{home}/out", f"{home}/log")
    return t.spark.read.schema("source_id string, reason string, label string, status string, body_kept boolean").parquet(f"{home}/out").drop("batch")


# Streams with state -------------------------------------------------------------------------------------------------
#: Turns arrive a minute apart within a day of their conversation; two in three get an envelope, some of them late.
def arrivals(rows: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("conv_id") % 1000) * 3600 + F.col("turn") * 61)
    return rows.select(F.lit("chat").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("source_id"), at.alias("received_at"), ((F.col("conv_id") + F.col("turn")) % 3).alias("_k"))


def enveloped(rows: DataFrame) -> DataFrame:
    df = arrivals(rows).where("_k > 0")
    late = F.when(F.col("_k") == 1, F.expr("INTERVAL 2 MINUTES")).otherwise(F.expr("INTERVAL 9 MINUTES"))
    return df.select("source", "source_id", (F.col("received_at") + late).alias("ingested_at"))


ORPHANS = """
WITH a AS (SELECT 'chat' AS source, conv_id || '-' || turn AS source_id, 1700000000 + (conv_id % 1000) * 3600 + turn * 61 AS s, (conv_id + turn) % 3 AS k FROM conversations),
w AS (SELECT least(max(s), max(s + CASE k WHEN 1 THEN 120 ELSE 540 END) FILTER (k > 0)) - 600 AS s FROM a)
SELECT source, source_id FROM a WHERE k <> 1 AND a.s + 300 < (SELECT s FROM w)
"""


@query(ORPHANS)
def raw_orphans(t):
    """Raw items without an envelope after five minutes, as of the time that a stream's watermark would have reached."""
    raw, env = arrivals(t.conversations), enveloped(t.conversations)
    marks = raw.agg(F.max("received_at").alias("m")).unionByName(env.agg(F.max("ingested_at").alias("m")))
    as_of = marks.agg(F.min("m") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    return stateful.orphans(raw, env, str(as_of)).select("source", "source_id")


@query(ORPHANS)
def stream_orphans(t):
    rows = lambda: stream_of(t, "conversations")
    return drained(t, stateful.stream_orphans(arrivals(rows()), enveloped(rows())).select("source", "source_id"))


COSTS = "lg AS (SELECT conv_id * 1000 + turn AS id, 1700000000 + (conv_id % 40) * 20000 + turn * 7 AS s, CAST((length(text) % 97) / 1000.0 AS DECIMAL(18, 6)) AS usd FROM conversations)"


def costs(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("conv_id") % 40) * 20000 + F.col("turn") * 7).alias("at"), (F.length("text") % 97 / 1000).cast("decimal(18,6)").alias("usd"))


@query(f"WITH {COSTS} SELECT id, CAST(running AS DOUBLE) AS running FROM (SELECT id, sum(usd) OVER (PARTITION BY s // 86400 ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS running FROM lg) WHERE running <= 1.5")
def stream_budget(t):
    """The spending gate as a stream: a day's sum is state."""
    return drained(t, stateful.stream_budget(costs(stream_of(t, "conversations")), 1.5).select("id", "running")).withColumn("running", F.col("running").cast("double"))


#: A conversation is a key, its turns are deliveries: every third fails, and all of every seventh conversation.
RETRIES = """
WITH d AS (SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AND conv_id % 7 > 0 AS ok FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM d),
g AS (SELECT conv_id, min(n) FILTER (ok) AS good, max(n) AS seen FROM n GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS key, CASE WHEN good <= 3 THEN 'good' ELSE 'dead' END AS outcome, CAST(least(coalesce(good, 3), 3) AS INTEGER) AS attempts FROM g WHERE good <= 3 OR seen >= 3
"""


def deliveries(rows: DataFrame) -> DataFrame:
    ok = ((F.col("conv_id") + F.col("turn")) % 3 == 0) & (F.col("conv_id") % 7 > 0)
    return rows.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.when(ok, F.to_json(obj(text=F.col("text")))).otherwise(F.concat(F.lit("{"), F.substring("text", 1, 20))).alias("payload"))


@query(RETRIES)
def retry_outcomes(t):
    return stateful.retry_outcomes(deliveries(t.conversations), 3).select("key", "outcome", "attempts")


@query(RETRIES)
def stream_retries(t):
    """Dead letters with retries as a stream: failures are counted in state."""
    return drained(t, stateful.stream_retries(deliveries(stream_of(t, "conversations")), 3).select("key", "outcome", "attempts"))


def status_of(rows: DataFrame) -> DataFrame:
    status: Column = F.when(F.col("turn") % 3 == 0, "normalized").when(F.length("text") < 200, "skipped").otherwise("extracted")
    return rows.select(status.alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("at"))


@query("SELECT CASE WHEN turn % 3 = 0 THEN 'normalized' WHEN length(text) < 200 THEN 'skipped' ELSE 'extracted' END AS status, count(*) AS n, 1700000000 + max(conv_id) AS newest FROM conversations GROUP BY 1")
def live_status(t):
    """Counts by status that a stream keeps up to date in a published table."""
    home = checkpoints.folder(t.spark)
    stateful.keep_counts(status_of(stream_of(t, "conversations")), f"{home}/counts", f"{home}/log").awaitTermination()
    return published(t.spark, f"{home}/counts").withColumn("newest", F.unix_timestamp("newest"))
