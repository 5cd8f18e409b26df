"""Shared plumbing: reading tables, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a single machine whose session names no shared folder (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/tidemark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder: the session's spark.checkpoint.dir, or else the context's
    checkpoint folder. A cluster without either is refused, as its machines share no local folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = LOCAL_SCRATCH
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str, files: int | None = None, passes: int = 1) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; at most `files` files, for a
    table that is known to be small. `passes` as of release().

    This cuts the lineage: what is read later survives the loss of any executor, and a table
    used twice is computed once. Shuffle files of the finished job are then released. Tables that
    a result is read from can't be discarded before it is; those go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    where, files_at = _at(spark, path)
    files_at.deleteOnExit(where)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    release(spark, passes)
    return back


def files_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """How many files a table of so many rows needs, `each` in one, but two for each core: a small
    table from many shuffle partitions isn't written as as many tiny files."""
    return max(2 * spark.sparkContext.defaultParallelism, 1 + rows // each)


def release(spark: SparkSession, passes: int = 1) -> None:
    """Let the context cleaner drop the shuffles of jobs that nothing refers to any more.

    What the first pass finalises on either side, a second one frees; else the next call does.
    """
    for _ in range(passes):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in frames:
        where, files_at = _at(df.sparkSession, df._tidemark_path)
        files_at.delete(where, True)
        files_at.cancelDeleteOnExit(where)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch: texts are long, and a batch is held at once
    on both sides. A single longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z and nothing else (lower() would change other letters too)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(df: DataFrame) -> list[Column]:
    """All columns of df, whatever is in their names."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, or what follows it among names that df doesn't have."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows of a few numbers each, which is counted;
    a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
