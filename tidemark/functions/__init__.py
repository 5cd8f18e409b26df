"""Column functions: portable hashing, ranking and metric building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 2^32) from the parts' decimal strings: the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.lit(p).cast("string") if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """key_hash() as a multiple of 1e-6 in [0, 1)."""
    return F.pmod(key_hash(*parts), F.lit(1_000_000)) / F.lit(1_000_000)


def first_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in that order, numbered from 1. Spark limits the rows of a
    group before the shuffle as well as after it."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).where(F.col(rank) <= k)


def gain(rank: Column) -> Column:
    """The discount of a hit at that rank, from 1."""
    return F.lit(1.0) / F.log2(rank.cast("double") + 1)


def ideal_gain(n: Column) -> Column:
    """The gain of n hits at the first n ranks."""
    ranks = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(ranks, F.lit(0.0), lambda total, r: total + gain(r))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_run_id(run_id: str) -> str:
    """Only letters, digits, _ and -: what may stand in a folder's name."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in run_id)


def safe_run_id_column(run_id: Column) -> Column:
    """safe_run_id() of a column."""
    return F.regexp_replace(run_id, "[^A-Za-z0-9_-]", "_")
