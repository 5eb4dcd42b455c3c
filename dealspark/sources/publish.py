"""Publishing a table in numbered versions: a reader sees one whole version at any moment, and writers never overwrite."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _store(spark: SparkSession, at: str):
    return _path(spark, at).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions there are, oldest first; none if nothing was published."""
    store, log = _store(spark, root), _path(spark, f"{root}/log")
    return sorted(int(f.getPath().getName()) for f in store.listStatus(log)) if store.exists(log) else []


def _points_to(spark: SparkSession, root: str, n: int) -> str:
    stream = _store(spark, root).open(_path(spark, f"{root}/log/{n:012d}"))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, root: str, keep: int = 3, grace: float = 3600.0) -> int:
    """Write df as the next version of `root` and give its number.

    The data is written beside the others under a name of its own; then a small file that names it is moved to the next
    number in the log, which fails if another writer took that number, and goes on to the one after. So a version is in
    the log only when it is whole, numbers are never reused, and a crash leaves at most data that no version names.
    Versions beyond the last `keep` go once they are older than `grace` seconds, so that readers can end."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    data, note = f"{root}/data/{name}", f"{root}/new/{name}"
    df.write.parquet(data)
    store = _store(spark, root)
    out = store.create(_path(spark, note), False)
    out.write(bytearray(data.encode()))
    out.close()
    store.mkdirs(_path(spark, f"{root}/log"))
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    n = (versions(spark, root) or [0])[-1] + 1
    while True:
        try:
            files.rename(_path(spark, note), _path(spark, f"{root}/log/{n:012d}"), never)
            break
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            n += 1
    for old in versions(spark, root)[: -max(1, keep)]:
        entry = _path(spark, f"{root}/log/{old:012d}")
        if store.exists(entry) and time.time() - store.getFileStatus(entry).getModificationTime() / 1000 >= grace:
            gone = _points_to(spark, root, old)
            store.delete(entry, False)
            store.delete(_path(spark, gone), True)
    return n


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version, or that of a number; an error if there is none."""
    found = versions(spark, root)
    n = version if version is not None else (found or [None])[-1]
    if n not in found:
        raise ValueError(f"no version {n} in {root}" if n is not None else f"nothing is published in {root}")
    return spark.read.parquet(_points_to(spark, root, n))
