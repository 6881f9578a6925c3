"""Durable intermediate tables in the folder that all executors share, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None
#: Bits of a bitmap of keys, as powers of two: 16 a key within these bounds, so 8 MB at most.
LEAST_BITS, MOST_BITS = 22, 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets one temporary folder; a
    cluster without it is refused, since executors would not see the files.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local_dir


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/cellgrid-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that still read from it must be written before."""
    removed(spark, run_dir(spark))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens where there is none."""
    at, fs = _file(spark, path)
    fs.delete(at, True)


def present(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths directly in a folder, by name; none where it is no folder."""
    at, fs = _file(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(at))


def published(spark: SparkSession, staged: str, path: str) -> None:
    """Move a finished folder to its place, in the same file system."""
    (at, fs), (to, _) = _file(spark, staged), _file(spark, path)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"{staged} cannot be moved to {path}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of recomputing, and
    what is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside goes to Python in batches of ``n`` rows at most: rows of megabytes would else fill a batch of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, key: str, spread: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that has one row for each ``key``, of which one may be in a third of ``rows``.

    Rows are dealt to groups by ``spread``; each group asks once for a key, so
    no task gets all rows of one. ``rows`` is read twice.
    """
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(spread), F.lit(width(rows.sparkSession))))
    asked = dealt.select(key, "_group").distinct().join(table, key)
    return dealt.join(asked, [key, "_group"], how).drop("_group")


def perhaps_in(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true wherever ``key`` is one of ``keys``, and for few others.

    The distinct values of the one column of ``keys``, stored and of the type of
    ``key``, are hashed to a bitmap of bounded size that is broadcast by words, so no row moves.
    What is true needs an exact join; beyond millions of keys more rows do.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))

    def place(k: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(k), 64 - bits)

    def word(at: Column) -> Column:
        return F.shiftright(at, 6).bitwiseAND(7)

    own = keys.select(place(keys.columns[0]).alias("at")).select(F.shiftright("at", 9).alias("_page"), word(F.col("at")).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    pages = own.groupBy("_page").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bit"))).alias(f"w{i}") for i in range(8)])
    pages = pages.select("_page", F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(8)]).alias("_words"))
    dealt = rows.withColumn("_at", place(key)).withColumn("_page", F.shiftright("_at", 9))
    bit = F.getbit(F.get("_words", word(F.col("_at")).cast("int")), F.col("_at").bitwiseAND(63).cast("int"))
    found = dealt.join(F.broadcast(pages), "_page", "left").withColumn(name, F.coalesce(bit == 1, F.lit(False)))
    return found.drop("_at", "_page", "_words")
