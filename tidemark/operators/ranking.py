"""Candidates for learned ranking, their features and labels, and ranked scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot, first_per_group
from .evaluation import mask_seen
from .features import item_features, item_genres, unit_vectors, user_features, user_genres
from .models import likes, recent_history
from .splits import DAY, positive

CANDIDATES, RECENT = 200, 10
#: The feature lists; tests pin them.
BASE = ["retriever_score", "retriever_rank", "ease_score", "ease_rank", "item_log_n", "item_log_pos", "item_mean", "item_days_since_last", "item_age_days", "user_log_n", "user_log_pos", "user_mean", "genre_overlap", "genre_max", "content_sim_all", "content_sim_recent", "has_content"]
TIME = ["item_days_since_last", "item_age_days"]
PIT = ["pit_item_log_n", "pit_item_log_pos", "pit_item_mean", "pit_days_since_last", "pit_age_days"]
HEADLINE = [f for f in BASE if f not in TIME]
NO_EASE = [f for f in HEADLINE if not f.startswith("ease_")]
WITH_TIME = BASE
PIT_HEADLINE = [{"item_log_n": "pit_item_log_n", "item_log_pos": "pit_item_log_pos", "item_mean": "pit_item_mean"}.get(f, f) for f in HEADLINE]
PIT_WITH_TIME = [*PIT_HEADLINE, "pit_days_since_last", "pit_age_days"]


@dataclass
class Context:
    """What features are computed from: one training set, and content."""

    train: DataFrame
    items: DataFrame
    vectors: DataFrame  # item_id, vector


def candidates(scores: DataFrame, train: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """user_id, item_id, retriever_score, retriever_rank (from 0): the k best not rated in train."""
    own = mask_seen(scores, train.select("user_id", "item_id").distinct())
    best = first_per_group(own, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)
    return best.select("user_id", "item_id", F.col("score").alias("retriever_score"), (F.col("rank") - 1).alias("retriever_rank"))


def rank_among(df: DataFrame, score: str, name: str) -> DataFrame:
    """The place of a score among a user's candidates from 0; nulls last, ties in candidate order."""
    order = Window.partitionBy("user_id").orderBy(F.col(score).desc_nulls_last(), F.col("retriever_rank"))
    return df.withColumn(name, (F.row_number().over(order) - 1).cast("bigint"))


def statistics_features(cands: DataFrame, train: DataFrame) -> DataFrame:
    """Counts, means and ages of the item, counts and mean of the user; null if unseen in train."""
    i = item_features(train).select("item_id", F.log1p("n_ratings").alias("item_log_n"), F.log1p("n_positives").alias("item_log_pos"), F.col("mean_rating").alias("item_mean"), "first_rated_ts", F.col("last_rated_ts").alias("item_last"))
    u = user_features(train).select("user_id", F.log1p("n_ratings").alias("user_log_n"), F.log1p("n_positives").alias("user_log_pos"), F.col("mean_rating").alias("user_mean"), F.col("last_rated_ts").alias("user_last"))
    df = cands.join(i, "item_id", "left").join(u, "user_id", "left")
    days = lambda since: (F.col("user_last") - F.col(since)) / F.lit(float(DAY))
    return df.withColumns({"item_days_since_last": days("item_last"), "item_age_days": days("first_rated_ts")}).drop("first_rated_ts", "item_last", "user_last")


def genre_features(cands: DataFrame, train: DataFrame, items: DataFrame) -> DataFrame:
    """genre_overlap and genre_max: sum and maximum of the user's shares of the item's genres, else 0."""
    shares = cands.select("user_id", "item_id").join(item_genres(items), "item_id").join(user_genres(train, items), ["user_id", "genre"])
    per = shares.groupBy("user_id", "item_id").agg(F.sum("share").alias("genre_overlap"), F.max("share").alias("genre_max"))
    df = cands.join(per, ["user_id", "item_id"], "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("genre_overlap", "genre_max")})


def profiles(history: DataFrame, unit: DataFrame) -> DataFrame:
    """user_id, profile: the sum of the unit vectors of a history, at length 1; items without one don't count.

    Vectors of one length are summed whole, with a partial sum in each task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = history.join(unit, "item_id").select("user_id", array_to_vector("vector").alias("v"))
    whole = parts.groupBy("user_id").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("vector"))
    return unit_vectors(whole).withColumnRenamed("vector", "profile")


def content_features(cands: DataFrame, context: Context) -> DataFrame:
    """Cosines of the item with all, and with the last, positives of the user, and has_content.

    The last ones are the last positives, of which those without a vector then drop out.
    """
    unit = unit_vectors(context.vectors)
    described = cands.select("user_id", "item_id").join(unit, "item_id")
    sims = described
    for name, history in (("content_sim_all", likes(context.train)), ("content_sim_recent", recent_history(context.train, RECENT))):
        own = profiles(history, unit).withColumnRenamed("profile", "p")
        sims = sims.join(own, "user_id", "left").withColumn(name, F.when(F.col("p").isNotNull(), dot(F.col("vector"), F.col("p")))).drop("p")
    sims = sims.select("user_id", "item_id", "content_sim_all", "content_sim_recent", F.lit(1).alias("has_content"))
    return cands.join(sims, ["user_id", "item_id"], "left").withColumn("has_content", F.coalesce("has_content", F.lit(0)))


def point_in_time(probes: DataFrame, ratings: DataFrame) -> DataFrame:
    """probes (user_id, item_id, cutoff) with the PIT features: what all ratings of the item before
    cutoff add up to, strictly.

    Ratings and probes are one stream per item in order of time, and a range frame that ends a
    second before a row's own time sums up the ratings. This is linear; a join on an inequality
    would make every pair. An item with very many rows is split by time first: each slice starts
    from the sums of the slices before it, so no single task has to hold a frequent item.
    """
    counted = ratings.select("item_id", F.col("ts").alias("at"), F.lit(None).cast("bigint").alias("user_id"), "rating")
    asked = probes.select("item_id", F.col("cutoff").alias("at"), "user_id", F.lit(None).cast("double").alias("rating"))
    rows = counted.unionByName(asked).withColumn("slice", F.floor(F.col("at") / F.lit(30 * DAY)))
    is_rating = F.col("user_id").isNull()
    sums = {"n": F.count(F.when(is_rating, 1)), "p": F.count(F.when(is_rating & positive(), 1)), "s": F.sum("rating"), "last": F.max(F.when(is_rating, F.col("at"))), "first": F.min(F.when(is_rating, F.col("at")))}
    # Few rows: one for each item and slice.
    slices = rows.groupBy("item_id", "slice").agg(*[c.alias(f"x_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy("item_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"n": F.sum, "p": F.sum, "s": F.sum, "last": F.max, "first": F.min}
    slices = slices.select("item_id", "slice", *[f(f"x_{k}").over(earlier).alias(f"b_{k}") for k, f in fold.items()])
    within = Window.partitionBy("item_id", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.select("item_id", "slice", "user_id", "at", *[c.over(within).alias(f"w_{k}") for k, c in sums.items()]).where("user_id is not null")
    df = rows.join(slices, ["item_id", "slice"])
    zero = F.lit(0)
    n, p, s = (F.coalesce(f"b_{k}", zero) + F.coalesce(f"w_{k}", zero) for k in "nps")
    last, first = F.greatest("b_last", "w_last"), F.least("b_first", "w_first")
    days = lambda since: (F.col("at") - since) / F.lit(float(DAY))
    return df.select("user_id", "item_id", F.log1p(n).alias("pit_item_log_n"), F.log1p(p).alias("pit_item_log_pos"), F.when(n > 0, s / n).alias("pit_item_mean"), days(last).alias("pit_days_since_last"), days(first).alias("pit_age_days"))


def last_train_ts(train: DataFrame) -> DataFrame:
    return train.groupBy("user_id").agg(F.max("ts").alias("cutoff"))


def rank_features(cands: DataFrame, context: Context, ease: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """All features of candidates; EASE scores (user_id, item_id, score) and all ratings (for the
    point-in-time ones) where given. Null is missing."""
    df = cands
    if ease is not None:
        df = df.join(ease.withColumnRenamed("score", "ease_score"), ["user_id", "item_id"], "left")
        df = rank_among(df, "ease_score", "ease_rank")
    df = genre_features(statistics_features(df, context.train), context.train, context.items)
    df = content_features(df, context)
    if ratings is not None:
        probes = cands.select("user_id", "item_id").join(last_train_ts(context.train), "user_id")
        df = df.join(point_in_time(probes, ratings), ["user_id", "item_id"], "left")
    return df


def labelled(features: DataFrame, relevant: DataFrame) -> DataFrame:
    """features with label 1 for relevant pairs, else 0, of users with any: others teach no order."""
    df = features.join(relevant.select("user_id", "item_id").distinct().withColumn("label", F.lit(1)), ["user_id", "item_id"], "left")
    df = df.withColumn("label", F.coalesce("label", F.lit(0)))
    return df.withColumn("__any", F.max("label").over(Window.partitionBy("user_id"))).where("__any = 1").drop("__any")


def require_labelled(df: DataFrame) -> DataFrame:
    if not df.limit(1).count():
        raise ValueError("no user has a relevant candidate")
    return df


def adapt_scores(cands: DataFrame, predictions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """user_id, item_id, score: predictions shifted so that a user's lowest is one above its best base
    score; pairs that are no candidates keep the base score, and can't be scored without one."""
    user = Window.partitionBy("user_id")
    own = cands.select("user_id", "item_id").join(predictions.select("user_id", "item_id", F.col("score").alias("pred")), ["user_id", "item_id"])
    if base is None:
        return own.select("user_id", "item_id", F.col("pred").alias("score"))
    best = base.groupBy("user_id").agg(F.max("score").alias("best"))
    shifted = own.join(best, "user_id", "left").select("user_id", "item_id", (F.col("pred") - F.min("pred").over(user) + F.coalesce("best", F.lit(0.0)) + 1).alias("score"))
    rest = base.select("user_id", "item_id", "score").join(own, ["user_id", "item_id"], "left_anti")
    return shifted.unionByName(rest)


def ranker_users(train: DataFrame, relevant: DataFrame, n: int = 30_000, seed: int = 0) -> DataFrame:
    """At most n users, by hash, with a positive in train and something to learn from."""
    from .evaluation import subsample

    return subsample(likes(train).select("user_id").distinct().intersect(relevant.select("user_id").distinct()), n, seed)


def feature_gap(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """One row: pairs in one frame only, and the largest difference of any feature; null equals null."""
    both = a.alias("l").join(b.alias("r"), (F.col("l.user_id") == F.col("r.user_id")) & (F.col("l.item_id") == F.col("r.item_id")), "full_outer")
    alone = F.col("l.user_id").isNull() | F.col("r.user_id").isNull()

    def gap(n: str) -> Column:
        x, y = F.col(f"l.{n}"), F.col(f"r.{n}")
        return F.when(alone | (x.isNull() & y.isNull()), 0.0).when(x.isNull() | y.isNull(), float("inf")).otherwise(F.abs(x - y))

    total = F.coalesce(F.sum(alone.cast("bigint")), F.lit(0)).cast("bigint")
    widest = F.greatest(F.lit(0.0), *[gap(n) for n in names])
    return both.agg(total.alias("unmatched"), F.coalesce(F.max(widest), F.lit(0.0)).alias("max_gap"))
