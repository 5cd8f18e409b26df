"""Train, validation and test splits of an interaction log, their invariants and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import key_hash, uniform

POSITIVE = 4.0
MIN_RATINGS = 10
SEED = 42
SCHEMES = ("user", "global", "random")
HOUR, DAY = 3600, 86_400
#: Rows a model may learn from, by name.
TRAINING_SETS = {"train_core": "train_part = 'core'", "train": "split_user = 'train'", "train_val": "split_user IN ('train', 'val')"}


def positive() -> Column:
    return F.col("rating") >= POSITIVE


def _labels(is_train: Column, is_val: Column) -> Column:
    return F.when(is_train, "train").when(is_val, "val").otherwise("test")


def per_user_split(ratings: DataFrame, min_ratings: int = MIN_RATINGS) -> DataFrame:
    """split_user: each user's first 8 tenths, next tenth and rest by (ts, item_id); users with
    few ratings train only. train_part: the first 7 eighths of train are core, the rest tail.

    Place and count of a row come from one shuffle and one sort.
    """
    user = Window.partitionBy("user_id")
    df = ratings.withColumns({"__i": F.row_number().over(user.orderBy("ts", "item_id")), "__n": F.count("*").over(user)})
    small = F.col("__n") < min_ratings
    upto = lambda tenths: F.when(small, F.col("__n")).otherwise(F.expr(f"__n * {tenths} div 10"))
    df = df.withColumns({"__train": upto(8), "__val": upto(9)})
    df = df.withColumn("split_user", _labels(F.col("__i") <= F.col("__train"), F.col("__i") <= F.col("__val")))
    part = F.when(F.col("__i") <= F.expr("__train * 7 div 8"), "core").otherwise("tail")
    return df.withColumn("train_part", F.when(F.col("split_user") == "train", part)).drop("__i", "__n", "__train", "__val")


def global_cutoffs(ratings: DataFrame) -> DataFrame:
    """One row, t80 and t90: exact interpolated percentiles of ts, cut to whole seconds."""
    q = F.expr("percentile(ts, array(0.8D, 0.9D))")
    return ratings.agg(q.alias("q")).select(F.floor(F.col("q")[0]).alias("t80"), F.floor(F.col("q")[1]).alias("t90"))


def global_split(ratings: DataFrame, t80: int, t90: int) -> DataFrame:
    """split_global: up to t80, up to t90, after."""
    return ratings.withColumn("split_global", _labels(F.col("ts") <= t80, F.col("ts") <= t90))


def random_split(ratings: DataFrame, seed: int = SEED, engine_hash: bool = False) -> DataFrame:
    """split_random by a hash of seed and key: 8, 1 and 1 tenths, however the rows are partitioned.

    engine_hash takes Spark's xxhash64 of 32-bit ids instead of the portable hash.
    """
    own = F.pmod(F.xxhash64(F.lit(seed), F.col("user_id").cast("int"), F.col("item_id").cast("int")), F.lit(1_000_000)) / F.lit(1_000_000)
    u = own if engine_hash else uniform(seed, "user_id", "item_id")
    return ratings.withColumn("split_random", _labels(u < 0.8, u < 0.9))


def build_splits(ratings: DataFrame, engine_hash: bool = False) -> DataFrame:
    """All three schemes. The two cutoffs are the only values that come to the driver."""
    cuts = global_cutoffs(ratings).first()
    df = random_split(global_split(per_user_split(ratings), cuts["t80"], cuts["t90"]), engine_hash=engine_hash)
    return df.select("user_id", "item_id", "rating", "ts", "split_user", "train_part", "split_global", "split_random")


def training_set(splits: DataFrame, name: str) -> DataFrame:
    return splits.where(TRAINING_SETS[name])


def split_violations(splits: DataFrame, n_ratings: int, t80: int, t90: int, min_ratings: int = MIN_RATINGS) -> DataFrame:
    """(rule, violations), one row per invariant, from one pass over rows and one over users."""
    ts = F.col("ts")
    of = lambda label: F.when(F.col("split_user") == label, ts)
    part = lambda label: F.when(F.col("train_part") == label, ts)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    rules = {f"label_{s}": count(~F.col(f"split_{s}").isin("train", "val", "test") | F.col(f"split_{s}").isNull()) for s in SCHEMES}
    rules["row_total"] = F.abs(F.count("*") - F.lit(n_ratings))
    rules["train_part"] = count((F.col("split_user") == "train") != F.col("train_part").isNotNull())
    g = F.col("split_global")
    rules["global_bounds"] = count((g == "train") & (ts > t80) | (g == "val") & ((ts <= t80) | (ts > t90)) | (g == "test") & (ts <= t90))
    rows = splits.agg(*[c.alias(n) for n, c in rules.items()])
    users = splits.groupBy("user_id").agg(
        F.max(of("train")).alias("train_hi"), F.min(of("val")).alias("val_lo"), F.max(of("val")).alias("val_hi"), F.min(of("test")).alias("test_lo"),
        F.max(part("core")).alias("core_hi"), F.min(part("tail")).alias("tail_lo"), F.count("*").alias("n"), F.count(F.when(F.col("split_user") != "train", 1)).alias("held"),
    )
    late = "train_hi > val_lo or val_hi > test_lo or train_hi > test_lo or core_hi > tail_lo"
    users = users.agg(count(F.coalesce(F.expr(late), F.lit(False))).alias("time_order"), count((F.col("n") < min_ratings) & (F.col("held") > 0)).alias("small_users"))
    both = [(rows, list(rules)), (users, ["time_order", "small_users"])]
    parts = [df.select(F.expr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (rule, violations)")) for df, names in both]
    return parts[0].unionByName(parts[1])


def check_splits(splits: DataFrame, n_ratings: int, t80: int, t90: int) -> None:
    """Raises AssertionError naming every broken invariant."""
    broken = [f"{r['rule']}: {r['violations']}" for r in split_violations(splits, n_ratings, t80, t90).where("violations > 0").collect()]
    if broken:
        raise AssertionError("; ".join(broken))


def split_counts(splits: DataFrame, scheme: str) -> DataFrame:
    return splits.groupBy(F.col(f"split_{scheme}").alias("split")).agg(F.count("*").alias("n"))


def split_user_stats(splits: DataFrame, scheme: str) -> DataFrame:
    """One row: users, those with a positive in train, the others, and those with one in val, test too."""
    label = F.col(f"split_{scheme}")
    has = {s: F.max(((label == s) & positive()).cast("int")).alias(s) for s in ("train", "val", "test")}
    users = splits.groupBy("user_id").agg(*has.values())
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return users.agg(
        F.count("*").alias("users_total"), total(F.col("train"), "users_eligible"), total(1 - F.col("train"), "users_excluded"),
        total(F.col("train") * F.col("val"), "eligible_with_val"), total(F.col("train") * F.col("test"), "eligible_with_test"),
    )


def fingerprint(splits: DataFrame, scheme: str, engine_hash: bool = False) -> DataFrame:
    """One row: a sum of row hashes, the same for any order and partitioning of the rows."""
    label = F.col(f"split_{scheme}")
    h = F.xxhash64(F.col("user_id").cast("int"), F.col("item_id").cast("int"), label) if engine_hash else key_hash("user_id", "item_id", label)
    return splits.agg(F.sum(F.pmod(h, F.lit(1_000_000_007))).cast("bigint").alias("fingerprint"))


def user_bounds(splits: DataFrame, scheme: str = "user") -> DataFrame:
    """Each user's first and last ts in train, val and test, null where there is none."""
    label, ts = F.col(f"split_{scheme}"), F.col("ts")
    pick = {f"{s}_{n}": f(F.when(label == s, ts)) for s in ("train", "val", "test") for n, f in (("lo", F.min), ("hi", F.max))}
    return splits.groupBy("user_id").agg(*[c.alias(n) for n, c in pick.items()])


def burst_stats(splits: DataFrame) -> DataFrame:
    """One row: how short users' test spans are, and how close the train and val cut is."""
    users = user_bounds(splits).withColumns({"span": F.col("test_hi") - F.col("test_lo"), "gap": F.col("val_lo") - F.col("train_hi")})
    share = lambda c: F.avg(c.cast("double"))
    return users.agg(
        F.round(share(F.col("span") <= HOUR), 6).alias("test_span_1h"), F.round(share(F.col("span") <= DAY), 6).alias("test_span_24h"),
        F.round(F.expr("percentile(span / 3600.0D, 0.5D)"), 6).alias("test_span_median_h"),
        F.count(F.when(F.col("gap") == 0, 1)).alias("cut_same_second"), F.round(share(F.col("gap") <= HOUR), 6).alias("cut_1h_share"),
    )


def catalog_stats(splits: DataFrame, items: DataFrame, relevance: DataFrame, scheme: str = "user") -> DataFrame:
    """One row of item counts: all, rated, rated in train, only in val or test, with content vectors."""
    rated = splits.groupBy("item_id").agg(F.max((F.col(f"split_{scheme}") == "train").cast("int")).alias("in_train"), F.lit(1).alias("rated"))
    described = relevance.select("item_id").distinct().withColumn("described", F.lit(1))
    all_ = items.select("item_id").distinct().withColumn("listed", F.lit(1)).join(rated, "item_id", "full_outer").join(described, "item_id", "full_outer")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return all_.agg(total(F.col("listed"), "items_total"), total(F.col("rated"), "items_rated"), total(F.col("in_train"), "items_in_train"), total(F.col("rated") - F.col("in_train"), "items_only_held_out"), total(F.col("listed") * F.col("described"), "items_described"))
