"""Interactions, catalogue and content vectors, as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_GENRES = "(no genres listed)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating (half stars), ts: each customer's first line for each part.

    The earliest line is an aggregate, so that tasks merge lines before they are shuffled.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    first = F.min(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")).alias("f")
    kept = both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(first)
    return kept.select("user_id", "item_id", (F.ceil(F.col("f.l_quantity") / 5) / 2).cast("double").alias("rating"), F.unix_timestamp(F.col("f.o_orderdate").cast("timestamp")).alias("ts"))


def ratings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from the event stream's table: the item is the k of an event's JSON."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"))
    first = F.min(F.struct("ts", "event_id", "value")).alias("f")
    kept = events.where("item_id is not null").groupBy("user_id", "item_id").agg(first)
    return kept.select("user_id", "item_id", ((F.pmod(F.floor("f.value"), F.lit(10)) + 1) / 2).cast("double").alias("rating"), F.unix_timestamp(F.col("f.ts").cast("timestamp")).alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, genres (separated by |)."""
    genres = F.when(F.col("p_size") == 50, NO_GENRES).otherwise(F.replace("p_name", F.lit(" "), F.lit("|")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), genres.alias("genres"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, tag_id, relevance: content vectors in long form."""
    vectors = _table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("tag_id", "relevance")).select("item_id", F.col("tag_id").cast("bigint"), F.col("relevance").cast("double"))
