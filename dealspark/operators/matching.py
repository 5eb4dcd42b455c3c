"""Names in texts by one automaton, and the decision on every envelope: mails by their rules, all else by the gate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions import scalars as S
from . import normalize as N
from .checkpoints import cut

#: Names, and characters of them, up to which they are one broadcast automaton (some 40 bytes a character).
MAX_NAMES, MAX_CHARS = 200_000, 4_000_000
#: Known senders (counted) up to which their table is broadcast.
MAX_SENDERS = 200_000


def fetched_names(names: DataFrame, column: str, least: int, most: int = MAX_NAMES, chars: int = MAX_CHARS) -> list[str] | None:
    """The distinct names of at least `least` characters in lower case; None if they are more than the bounds (counted)."""
    low = names.select(F.lower(column).alias("name")).where(F.length("name") >= least).distinct()
    n, size = low.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    return sorted(r["name"] for r in low.collect()) if n <= most and size <= chars else None


def with_names(df: DataFrame, text: str, names: list[str], into: str = "names") -> DataFrame:
    """df and `into`, the distinct names inside its `text` (array, sorted; null text: empty). Text and names are compared as
    they are, so lower both first. Each row is read once by an Aho-Corasick automaton, whatever the number of names; the
    automaton is broadcast and unpacked once a worker. Row by row, so it serves streams as well."""
    if not names:
        return df.withColumn(into, F.array().cast("array<string>"))
    trie = ahocorasick.Automaton()
    for x in names:
        trie.add_word(x, x)
    trie.make_automaton()
    shared = df.sparkSession.sparkContext.broadcast(trie)
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [sorted({x for _, x in own.iter(t)}) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, into])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField(into, T.ArrayType(T.StringType()))])
    return df.mapInArrow(run, schema)


def known_senders(df: DataFrame, senders: DataFrame, sender: str = "sender", into: str = "known") -> DataFrame:
    """df and `into`: whether the address in `sender`, or the bare sender (a number), is among senders (key), in any case. A
    static table beside a batch or a stream; broadcast while it counts few rows. Null and empty senders are unknown."""
    keys = senders.select(F.lower(F.trim("key")).alias("_key")).where("_key <> ''").distinct()
    keys = F.broadcast(keys) if keys.count() <= MAX_SENDERS else keys.hint("merge")
    own = F.coalesce(S.email_of(sender), F.lower(F.trim(sender)))
    return df.withColumn("_own", own).join(keys, F.col("_own") == F.col("_key"), "left").withColumn(into, F.col("_key").isNotNull()).drop("_own", "_key")


def decide(envelopes: DataFrame, senders: DataFrame, names: DataFrame, rules: R.Rules = R.Rules(), least: int = 4, most: int = MAX_NAMES) -> DataFrame:
    """Envelopes of `dispatch.map_items` with status, skip_reason, reason and signal_score, in a batch or a stream.

    Mails follow the mail rules, with known senders (key) and names (canonical) of the spine joined in: indexed ones get
    0.95 and their label, skipped ones 0, and confidential ones lose their body. All other items follow the gate's score.
    More names than the automaton may hold meet the texts by `normalize.mentions`, in a batch, or in each micro-batch of a
    stream by `streams.run_batches`."""
    subject = F.coalesce(N.header("Subject"), F.lit(""))
    df = known_senders(envelopes, senders).withColumn("_text", F.when(F.col("source") == "gmail", F.lower(F.concat_ws("\n", subject, F.coalesce("body_clean", F.lit(""))))))
    found = fetched_names(names, "canonical", least, most)
    if found is not None:
        df = with_names(df, "_text", found, "_names").withColumn("_mention", F.size("_names") > 0).drop("_names")
    elif df.isStreaming:
        raise ValueError(f"a stream can't search for more than {most} names of {MAX_CHARS} characters in all; decide its micro-batches (streams.run_batches)")
    else:
        df = cut(df)  # three reads follow, and the mapping of a payload costs more than they do
        hits = N.mentions(df.where("_text IS NOT NULL").select(F.col("idempotency_key").alias("doc_id"), F.col("_text").alias("text")), names.select(F.lit("").alias("id"), "canonical"), least, 0)
        hits = hits.select(F.col("doc_id").alias("_hit")).distinct()
        df = df.join(hits.hint("merge"), F.col("idempotency_key") == F.col("_hit"), "left").withColumn("_mention", F.col("_hit").isNotNull()).drop("_hit")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    mail = df.withColumns({"body": F.col("body_clean"), "label_ids": none("label_ids", "array<string>"), "headers": none("headers", "array<struct<name:string,value:string>>")})
    df = N.classify_mail(mail, rules, F.col("_mention"), F.col("known")).drop("body", "_text", "_mention")
    is_mail, action = F.col("source").eqNullSafe(F.lit("gmail")), F.col("decision.action")
    score = N.signal_score(rules, known=F.col("known"), attachment=F.col("has_attachment"))
    df = df.withColumn("signal_score", F.when(is_mail, F.when(action == "index", 0.95).otherwise(0.0)).otherwise(score))
    passed = F.when(is_mail, action == "index").otherwise(F.col("signal_score") >= rules.threshold)
    reason = F.when(is_mail, F.col("decision.reason")).when(~passed, "low_signal")
    df = df.withColumns({"status": F.when(passed, "normalized").otherwise("skipped"), "reason": reason, "skip_reason": F.when(~passed, reason), "labels": F.when(is_mail & (action == "index"), F.array("decision.label")).otherwise(F.col("labels"))})
    secret = F.coalesce(F.col("skip_reason").startswith("confidential"), F.lit(False))
    return df.withColumns({c: F.when(~secret, F.col(c)) for c in ("body_raw", "body_clean")}).drop("decision")
