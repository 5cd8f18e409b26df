"""Item, user, genre and content features of one training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm
from ..sources.views import NO_GENRES
from .splits import positive


def _summary() -> list:
    return [F.count("*").alias("n_ratings"), F.count(F.when(positive(), 1)).alias("n_positives"), F.avg("rating").alias("mean_rating")]


def item_features(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(*_summary(), F.min("ts").alias("first_rated_ts"), F.max("ts").alias("last_rated_ts"))


def user_features(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(*_summary(), F.max("ts").alias("last_rated_ts"))


def item_genres(items: DataFrame) -> DataFrame:
    """item_id, genre: one row for each of an item's genres."""
    named = items.where((F.col("genres") != NO_GENRES) & (F.col("genres") != ""))
    return named.select("item_id", F.explode(F.array_distinct(F.split("genres", r"\|"))).alias("genre"))


def user_genres(train: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, genre, share of the user's positives that have the genre (all positives count)."""
    liked = train.where(positive()).select("user_id", "item_id")
    # The total is taken on the key that the groups are dealt by anyway.
    liked = liked.withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    pairs = liked.join(item_genres(items), "item_id").groupBy("user_id", "genre", "n").agg(F.count("*").alias("k"))
    return pairs.select("user_id", "genre", (F.col("k") / F.col("n")).alias("share"))


def content_vectors(relevance: DataFrame) -> DataFrame:
    """item_id, vector: relevances in order of tag."""
    rows = F.array_sort(F.collect_list(F.struct("tag_id", "relevance")))
    return relevance.groupBy("item_id").agg(rows.getField("relevance").alias("vector"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """The vectors at length 1; a zero vector stays."""
    return vectors.withColumn("__l", norm(F.col("vector"))).withColumn("vector", F.when(F.col("__l") > 0, F.transform("vector", lambda x: x / F.col("__l"))).otherwise(F.col("vector"))).drop("__l")


def feature_tables(train: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    return {"items": item_features(train), "users": user_features(train), "user_genres": user_genres(train, items)}
