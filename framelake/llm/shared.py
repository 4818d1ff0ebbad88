"""Folders, tables, row identity and joins that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than a HOT-th of all rows, and more than LEAST_HOT rows; so there are at most HOT such keys.
HOT, LEAST_HOT = 500, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where neither the setting nor a checkpoint directory is there, a temporary folder is made
    and set for the session, but only if driver and executors are one process (tests); on a
    cluster no other executor would see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        folder = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


#: Paths of the tables that ``written`` has made and ``forget`` has not removed, oldest first.
made: list[str] = []


#: Rows that Spark hands to Python at a time, unless the session says otherwise: texts may be very long.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold of a table at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(BATCH))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there,
    and a lost executor costs no work done before."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/framelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._framelake_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_framelake_path", None):
            remove(df.sparkSession, path)
            made.remove(path)


def forget_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes what ``written`` has made after the first ``mark`` tables, but ``keep``."""
    kept = {getattr(df, "_framelake_path", None) for df in keep}
    for path in [p for p in made[mark:] if p not in kept]:
        remove(spark, path)
        made.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def text_key(text: str | Column) -> Column:
    """A name of a text by two hashes; null is a text of its own."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.hex(F.xxhash64(text)), F.lit("."), F.hex(F.hash(text)))


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row, so rows that share it are equal (maps count as their JSON)."""
    columns = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields]
    return F.xxhash64(*columns)


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and, as ``n``, the number of rows of that key.

    Keys of more than a HOT-th of the ``total`` rows, HOT at most, go to every task, so their rows stay where
    they are; the others meet by a shuffle in which no key is large.
    """
    if total <= LEAST_HOT:
        return rows.join(side, on)
    most = max(LEAST_HOT, total // HOT)
    hot = F.broadcast(side.where(F.col(n) > most))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(side.where(F.col(n) > most).select(*on)), on, "left_anti").join(side.where(F.col(n) <= most), on))


def shuffled(rows: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` by a shuffle and a sort of both, whatever Spark takes their sizes to be.

    It counts what an ``explode`` makes as no larger than what goes in, and a packed file as what it takes on disk; a
    side that is many times its estimate would be gathered on the driver for a broadcast.
    """
    return rows.hint("merge").join(side, on, how)


def first_rows(docs: DataFrame, first: DataFrame, text: str) -> DataFrame:
    """One row of ``docs`` of each group: ``first`` has (group, first), first a struct (none, id, dh, rh) of a row's id
    (none: whether it is null), text hash and row key; a group's least counts, and of equal rows one."""
    least = first.groupBy("group").agg(F.min("first").alias("first"))
    keep = least.select(F.col("first.dh").alias("__dh"), F.col("first.rh").alias("__rh"))
    marked = docs.withColumns({"__dh": F.xxhash64(text), "__rh": row_key(docs)})
    return marked.join(keep, ["__dh", "__rh"], "left_semi").dropDuplicates(["__dh", "__rh"]).select(*[F.col(f"`{c}`") for c in docs.columns])
