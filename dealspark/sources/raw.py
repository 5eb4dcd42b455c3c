"""Landing raw items: native-id dedup, incremental reads, files, seed tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def land_raw(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each (source, source_id) that existing has not; incoming: (source, source_id, body, seq)."""
    w = Window.partitionBy("source", "source_id").orderBy("seq")
    new = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return new.join(existing.select("source", "source_id"), ["source", "source_id"], "left_anti") if existing is not None else new


def explode_messages(df: DataFrame) -> DataFrame:
    """A webhook body's messages as rows; those without an id are left out."""
    body = F.from_json("body", "messages array<struct<id:string,from:string,timestamp:bigint,text:string>>")
    return df.select(F.explode(F.coalesce(body["messages"], F.array())).alias("m")).where("m.id IS NOT NULL").select("m.*")


def load_spine(csv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a seed table with columns company, investors (a comma list), sector, in any case."""
    df = csv.toDF(*[c.strip().lower() for c in csv.columns]).where("trim(company) <> ''")
    inv = df.select(F.trim("company").alias("company"), F.explode(S.split_list("investors", ",")).alias("investor"))
    companies = df.select(F.lit("company").alias("type"), F.trim("company").alias("canonical"), S.canon_sector("sector").alias("sector"))
    deals = df.select(F.lit("deal").alias("type"), F.concat(F.trim("company"), F.lit(" — Round")).alias("canonical"), F.lit(None).cast("string").alias("sector"))
    investors = inv.select(F.lit("investor").alias("type"), F.col("investor").alias("canonical"), F.lit(None).cast("string").alias("sector"))
    deal = F.concat("company", F.lit(" — Round"))
    edges = df.select(F.concat(F.trim("company"), F.lit(" — Round")).alias("src"), F.lit("involves").alias("rel"), F.trim("company").alias("dst"))
    return companies.unionByName(deals).unionByName(investors).distinct(), edges.unionByName(inv.select(F.col("investor").alias("src"), F.lit("invested_in").alias("rel"), deal.alias("dst"))).distinct()


def read_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Text lines (value) as (good rows, bad lines); blank lines are neither, what isn't an object is bad."""
    kept = lines.where(F.trim("value") != "")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return kept.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*"), kept.where(~ok)


def by_kind(rows: DataFrame, kinds: tuple[str, ...] = ("company", "document"), default: str = "company", column: str = "kind") -> dict[str, DataFrame]:
    """The rows of each kind, and `skipped`, those of any other; a row without a kind is of the default one. Each is a filter
    of one scan's rows."""
    kind = F.coalesce(F.lower(F.trim(column)), F.lit(default))
    kind = F.when(kind == "", default).otherwise(kind)
    return {k: rows.where(kind == k) for k in kinds} | {"skipped": rows.where(~kind.isin(*kinds))}


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Nested profiles of a file or folder, an object or a list each."""
    return spark.read.json(path, multiLine=True)


def read_profile_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(json): the objects of a file or folder as JSON text, for the profile parsers. Each file is an object or a list of
    them, or has one on each of its lines; what is no object goes."""
    v = spark.read.option("singleVariantColumn", "v").option("multiLine", not lines).json(path)
    each = v.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
    return each.where(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("json"))


def incremental(df: DataFrame, since: str | None, landed: DataFrame | None = None) -> DataFrame:
    """Rows at or after the high-water mark that are not landed yet."""
    out = df.where(F.col("at") >= F.lit(since).cast("timestamp_ntz")) if since else df
    return out.join(landed.select("source", "source_id"), ["source", "source_id"], "left_anti") if landed is not None else out


def next_mark(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.max("at").alias("mark"))


def land_events(df: DataFrame) -> DataFrame:
    """Calendar deltas (id, updated, status): cancelled ones go, a version is known by id@updated."""
    return df.where(F.coalesce("status", F.lit("")) != "cancelled").withColumn("source_id", F.concat_ws("@", "id", "updated"))


def land_files(files: DataFrame, existing: DataFrame | None = None, magic: str = "%PDF-") -> DataFrame:
    """(hash, path, status) of binary files (path, content): invalid ones, the first of each content, and duplicates."""
    df = files.select("path", F.sha2("content", 256).alias("hash"), (F.substring("content", 1, len(magic)).cast("string") == magic).alias("ok"))
    if existing is not None:
        df = df.join(existing.select("hash").distinct().withColumn("_had", F.lit(True)), "hash", "left")
    else:
        df = df.withColumn("_had", F.lit(None).cast("boolean"))
    n = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    return df.select("hash", "path", F.when(~F.col("ok"), "invalid").when(F.col("_had") | (n > 1), "skipped").otherwise("landed").alias("status"))


def message_text(df: DataFrame, parts: str = "parts") -> DataFrame:
    """text of parts (array of mime, data in base64): the first plain part, else the first HTML part without its tags."""
    pick = lambda mime: F.unbase64(F.get(F.filter(parts, lambda p: p["mime"] == mime), F.lit(0))["data"]).cast("string")
    return df.withColumn("text", F.coalesce(pick("text/plain"), S.html_to_text(pick("text/html")), F.lit("")))


def pdf_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    keep = F.filter(parts, lambda p: (F.coalesce(p["filename"], F.lit("")) != "") & ((p["mime"] == "application/pdf") | F.lower(p["filename"]).endswith(".pdf")))
    return df.select("*", F.explode(keep).alias("part"))


def worklist(sources: list[DataFrame], done: DataFrame, n: int | None = None) -> DataFrame:
    """Ids of several sources (id, pos) in order, without repeats and what is done."""
    both = None
    for k, s in enumerate(sources):
        own = s.select("id", F.struct(F.lit(k).alias("s"), "pos").alias("at"))
        both = own if both is None else both.unionByName(own)
    out = both.groupBy("id").agg(F.min("at").alias("at")).join(done.select("id"), "id", "left_anti").orderBy("at")
    return (out.limit(n) if n else out).select("id")


def filings_since(df: DataFrame, year: int) -> DataFrame:
    """Filings of the year or later, and those whose year isn't known."""
    y = F.substring("filing_date", 1, 4).try_cast("int")
    return df.where(y.isNull() | (y >= year))
