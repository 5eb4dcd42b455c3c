"""What the training-data operators share: tables in the shared folder, text blocks, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(typed(df)).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        if path := vars(df).pop("_stored_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id="doc_id"):
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, more: str = "") -> T.StructType:
    """The schema of df, all nullable, and the fields of `more` (DDL): as an object, so that names may hold any character."""
    extra = T.StructType.fromDDL(more).fields if more else []
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + extra)


def named(column: str):
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES: a worker and the JVM each hold a few of them, so that rows of any
    length cost the same memory. The limit is the session's; a lower one given in bytes stays. Columns whose names the
    resolver can't take as they are (dots, backticks) have other names inside `run`."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (conf.get(key) or "").removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = {c: c if c.isidentifier() else f"__odd_{i}" for i, c in enumerate(dict.fromkeys([*df.columns, *schema.names]))}
    inner = T.StructType([T.StructField(plain[f.name], f.dataType) for f in schema])
    return df.toDF(*[plain[c] for c in df.columns]).mapInArrow(run, inner).toDF(*schema.names)


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `most` bytes of text, or one longer row, and the texts as bytes (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        values = [v or b"" for v in column.to_pylist()]
        start = size = 0
        for i, v in enumerate(values):
            if i > start and size + len(v) > most:
                yield batch.slice(start, i - start), values[start:i]
                start, size = i, 0
            size += len(v)
        if start < len(values):
            yield batch.slice(start), values[start:]


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows of df (all, if there are fewer): those whose hash of the key is under n / count. Rows alike in the key
    come or stay away together, so make the result distinct before it is fetched.

    A count and a filter, so no task sorts or gathers more than it keeps; the same rows each time."""
    part = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40))
    count = df.count()
    return df.where(part < int((1 << 40) * n / count)) if count > n else df


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int], max_chars: int) -> list[tuple[str, int]]:
    """About per_class texts of each class (one number, or one of each) for fitting, never of held-out ids, chosen by a
    hash of doc_id.

    Rows with a null id or label, or a text of more than max_chars, are not used; of documents with one id that of the
    least hash is. So ids are safe to broadcast, and at most about sum(per_class) * max_chars characters are fetched."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    most = (per_class, per_class) if isinstance(per_class, int) else per_class
    parts = [hash_sample(rows.where(F.col("_y") == y), "_id", most[y]).distinct() for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    own = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.length("_text").between(1, max_chars))
    one = own.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    got = one.collect()
    return [(r["_text"], r["_y"]) for r in sorted(got, key=lambda r: (r["_id"], r["_y"], r["_text"]))]
