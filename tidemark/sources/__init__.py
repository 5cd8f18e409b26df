"""Readers and writers of logs, catalogues, features, results and manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REQUIRED = [("user_id", T.IntegerType()), ("item_id", T.IntegerType()), ("rating", T.DoubleType()), ("ts", T.LongType())]
RATINGS = T.StructType([T.StructField(n, t, False) for n, t in _REQUIRED])
ITEMS = T.StructType([T.StructField("item_id", T.IntegerType(), False), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
RELEVANCE = T.StructType([T.StructField("item_id", T.IntegerType(), False), T.StructField("tag_id", T.IntegerType(), False), T.StructField("relevance", T.DoubleType())])


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all machines share: the session's spark.checkpoint.dir or the
    context's checkpoint folder; on a single machine without either, a local one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file:///tmp/checkpoints/tidemark-core"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: what is read outlives any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and doubled quotes; a malformed row fails the read. The given
    schema saves the pass that inference needs."""
    return spark.read.schema(schema).options(header="true", quote='"', escape='"', mode="FAILFAST").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet file, folder or glob; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_interactions(spark: SparkSession, path: str, scheme: str = "user", fine: bool = False) -> DataFrame:
    """user_id, item_id, rating, ts, split of one scheme. fine splits the per-user scheme's train
    into train_core and train_tail; other schemes have no such parts."""
    if fine and scheme != "user":
        raise ValueError("only the per-user scheme has train parts")
    base = ["user_id", "item_id", "rating", "ts"]
    df = read_parquet(spark, path, [*base, f"split_{scheme}", *(["train_part"] if fine else [])])
    split = F.col(f"split_{scheme}")
    if fine:
        split = F.when(split == "train", F.concat(F.lit("train_"), F.col("train_part"))).otherwise(split)
    return df.select(*base, split.alias("split"))


def require_rows(df: DataFrame, at_least: int) -> DataFrame:
    """df, if it has that many rows: guards against a cut-off input."""
    n = df.count()
    if n < at_least:
        raise ValueError(f"{n} rows, expected {at_least} or more")
    return df


def checked_file(path: str, sha256: str | None = None, md5: str | None = None, lines: int | None = None) -> str:
    """path, if the local file's digests and number of lines are those given: guards an import."""
    digests, n = {"sha256": hashlib.sha256(), "md5": hashlib.md5()}, 0
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            n += block.count(b"\n")
            for d in digests.values():
                d.update(block)
    for name, want in (("sha256", sha256), ("md5", md5)):
        if want is not None and digests[name].hexdigest() != want.lower():
            raise ValueError(f"{path}: another {name}")
    if lines is not None and n != lines:
        raise ValueError(f"{path}: {n} lines, expected {lines}")
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_stats(rows: Iterable[tuple[str, str, object]], path: str) -> None:
    """(scheme, stat, value) rows, sorted, floats with six digits: equal runs give equal bytes."""
    text = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    with _replacing(path) as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["scheme", "stat", "value"])
        writer.writerows(sorted((scheme, stat, text(value)) for scheme, stat, value in rows))


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_rows(existing: DataFrame, new: DataFrame, key: str, value: object) -> DataFrame:
    """existing without the rows of that key, and new."""
    return existing.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new)


def replace_key(spark: SparkSession, path: str, new: DataFrame, key: str, value: object) -> None:
    """In the table at path, put new in the place of the rows of that key: a new table is written
    beside the old one, which it may read, and then takes its name. A missing table is empty."""
    where, fs = _file_system(spark, path)
    part, old = f"{path.rstrip('/')}.part", f"{path.rstrip('/')}.old"
    if fs.exists(where):
        new = replace_rows(spark.read.schema(new.schema).parquet(path), new, key, value)
    new.write.mode("overwrite").parquet(part)
    aside = _file_system(spark, old)[0]
    if fs.exists(where):
        fs.delete(aside, True)
        fs.rename(where, aside)
    fs.rename(_file_system(spark, part)[0], where)
    fs.delete(aside, True)


def write_json_atomic(value: object, path: str) -> None:
    """Readers see the old file or the new one, never half of it."""
    with _replacing(path) as file:
        json.dump(value, file, indent=2, sort_keys=True)


def put_json(spark: SparkSession, value: object, path: str) -> None:
    """write_json_atomic() to whatever store Spark reaches."""
    where, fs = _file_system(spark, path)
    part = _file_system(spark, f"{path}.part")[0]
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    if not fs.rename(part, where):  # some stores don't replace by renaming
        fs.delete(where, False)
        fs.rename(part, where)


def get_json(spark: SparkSession, path: str) -> object | None:
    """The value of put_json(); None without a file."""
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def written_at(spark: SparkSession, path: str) -> int | None:
    """When a file was last written; None without one."""
    where, fs = _file_system(spark, path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None


class _replacing:
    def __init__(self, path: str) -> None:
        self.path, self.part = path, f"{path}.part"

    def __enter__(self):
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        self.file = open(self.part, "w", encoding="utf-8", newline="")  # noqa: SIM115
        return self.file

    def __exit__(self, kind, *_: object) -> None:
        self.file.close()
        if kind is None:
            os.replace(self.part, self.path)
        else:
            os.remove(self.part)
