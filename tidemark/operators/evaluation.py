"""One evaluation protocol for all models, over long frames.

A model is a frame (user_id, item_id, score); an absent row means that it can't score the pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_per_group, gain, ideal_gain, key_hash
from ..sources import written
from .splits import positive

K, NEGATIVES, NEGATIVE_SEED = 10, 100, 20260922
CEILINGS = (50, 100, 200, 500)


@dataclass
class EvalData:
    population: DataFrame  # user_id
    seen: DataFrame  # user_id, item_id
    relevant: DataFrame  # user_id, item_id
    train_items: DataFrame  # item_id
    ever_rated: DataFrame  # user_id, item_id of the population


def _slices(target: str) -> list[str]:
    if target not in ("val", "test"):
        raise ValueError(f"unknown slice {target}")
    return ["train"] if target == "val" else ["train", "val"]


def eval_data(splits: DataFrame, scheme: str = "user", target: str = "val") -> EvalData:
    """Users with a positive in train (in train alone, also for test) and one in the target slice."""
    df = splits.select("user_id", "item_id", "rating", F.col(f"split_{scheme}").alias("split"))
    earlier = df.where(F.col("split").isin(_slices(target)))
    held = df.where((F.col("split") == target) & positive())
    likes = df.where(positive()).groupBy("user_id").agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") == target).cast("int")).alias("h"))
    users = likes.where("t = 1 and h = 1").select("user_id")
    of = lambda d: d.select("user_id", "item_id").join(users, "user_id", "left_semi").distinct()
    return EvalData(users, of(earlier), of(held), earlier.select("item_id").distinct(), of(df))


def prime_from(n: int) -> int:
    """The smallest prime >= n."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def numbered(items: DataFrame) -> DataFrame:
    """item_id, place: places from 0 in order of item_id, without gathering rows in one task."""
    spark = items.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    # Written, so that every later use sees the same ranges.
    dealt = written(items.select("item_id").distinct().repartitionByRange(parts, "item_id").withColumn("part", F.spark_partition_id()), "places")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one number a partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    base = spark.createDataFrame(offsets or [(0, 0)], "part int, base bigint")
    inner = F.row_number().over(Window.partitionBy("part").orderBy("item_id")) - 1
    return dealt.withColumn("inner", inner).join(F.broadcast(base), "part").select("item_id", (F.col("base") + F.col("inner")).cast("bigint").alias("place"))


def negatives(data: EvalData, n: int = NEGATIVES, seed: int = NEGATIVE_SEED) -> DataFrame:
    """user_id, item_id: n different items of the training slices that the user never rated.

    Each user walks the items in steps of its own through a prime number of places, which visits
    each place once, and takes the first n that count: the work is n plus the user's ratings, not
    the catalogue, and the draw depends on seed and user alone. The job fails if a user has fewer.
    """
    pool = written(numbered(data.train_items), "pool")
    size = pool.count()
    prime = prime_from(size)
    # A user's walk, and the places that it must not take, are two arrays of one row: no row of a
    # step is made or shuffled.
    rated = data.ever_rated.join(pool, "item_id", "left").groupBy("user_id").agg(F.count("*").alias("rated"), F.collect_set("place").alias("gone"))
    steps = F.least(F.lit(prime), F.lit(n + prime - size) + F.coalesce("rated", F.lit(0))).cast("bigint")
    a, b = F.pmod(key_hash(seed, "user_id", F.lit("a")), F.lit(prime)), F.lit(1) + F.pmod(key_hash(seed, "user_id", F.lit("b")), F.lit(max(1, prime - 1)))
    none = F.array().cast("array<bigint>")
    users = data.population.join(rated, "user_id", "left").select("user_id", F.coalesce("gone", none).alias("gone"), steps.alias("steps"), a.alias("a"), b.alias("b"))
    walk = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("steps") - 1), lambda j: F.pmod(F.col("a") + F.col("b") * j, F.lit(prime)).cast("bigint"))
    users = users.select("user_id", F.slice(F.filter(F.array_except(walk, F.col("gone")), lambda p: p < size), 1, n).alias("places"))
    short = F.raise_error(F.lit(f"some user has fewer than {n} items left to draw")).cast("array<bigint>")
    drawn = users.select("user_id", F.explode(F.when(F.size("places") == n, F.col("places")).otherwise(short)).alias("place"))
    return drawn.join(pool, "place").select("user_id", "item_id")


def check_scores(scores: DataFrame) -> DataFrame:
    """scores, if none is null, NaN or +infinity and no pair occurs twice."""
    bad = scores.where(F.col("score").isNull() | F.isnan("score") | (F.col("score") == float("inf"))).limit(1).count()
    twice = scores.groupBy("user_id", "item_id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("scores must be numbers, one for each pair")
    return scores


def validated(scores: DataFrame) -> DataFrame:
    """user_id, item_id, score; the job fails on a null, NaN or +infinity and on a pair that occurs
    twice. Checked where the rows are used, on the partitioning that masking needs anyway."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") == float("inf"))
    rows = scores.groupBy("user_id", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("__n"), F.max(bad).alias("__bad"))
    wrong = (F.col("__n") > 1) | F.col("__bad")
    return rows.select("user_id", "item_id", F.when(wrong, F.raise_error(F.lit("scores must be numbers, one for each pair")).cast("double")).otherwise(F.col("score").cast("double")).alias("score"))


def mask_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen, ["user_id", "item_id"], "left_anti")


def top_k(scores: DataFrame, k: int = K) -> DataFrame:
    """Each user's k highest scores, ties by item_id, with their rank from 1; -infinity doesn't count."""
    finite = scores.where(F.col("score") > float("-inf"))
    return first_per_group(finite, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)


def user_metrics(top: DataFrame, data: EvalData, k: int = K) -> DataFrame:
    """user_id, n_relevant, hits, recall (of at most k), ndcg, for every user of the population."""
    relevant = data.relevant.withColumn("__r", F.lit(1))
    hits = top.join(relevant, ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(gain(F.col("rank"))).alias("dcg"))
    users = data.relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant")).join(hits, "user_id", "left")
    ideal = F.least("n_relevant", F.lit(k).cast("bigint"))
    return users.select("user_id", "n_relevant", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), (F.coalesce("hits", F.lit(0)) / ideal).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal_gain(ideal)).alias("ndcg"))


def _scored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    score = F.coalesce("score", F.lit(float("-inf")))
    return pairs.join(scores.select("user_id", "item_id", "score"), ["user_id", "item_id"], "left").select("user_id", score.alias("score"))


def user_auc(scores: DataFrame, data: EvalData, drawn: DataFrame) -> DataFrame:
    """user_id, auc: how often a relevant item beats a drawn one, half for ties; what can't be scored ties."""
    return auc_of(_scored(data.relevant, scores), _scored(drawn, scores))


def auc_of(relevant: DataFrame, drawn: DataFrame) -> DataFrame:
    """user_id, auc of scored (user_id, score) relevant and drawn items.

    A user's drawn scores travel as one array of bounded length, not as a row for every pair.
    """
    own = drawn.groupBy("user_id").agg(F.collect_list("score").alias("against"))
    below = lambda q: F.when(F.col("score") > q, 1.0).when(F.col("score") == q, 0.5).otherwise(0.0)
    won = F.aggregate("against", F.lit(0.0), lambda total, q: total + below(q)) / F.size("against")
    return relevant.join(own, "user_id").groupBy("user_id").agg(F.avg(won).alias("auc"))


def skipped_users(data: EvalData, catalog: DataFrame) -> DataFrame:
    """user_id of those who have seen the whole catalogue: the only users that are left out."""
    n = catalog.select("item_id").distinct().count()
    seen = data.seen.join(catalog.select("item_id").distinct(), "item_id", "left_semi")
    return seen.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= n).select("user_id")


def coverage(top: DataFrame, data: EvalData) -> DataFrame:
    """One row: items recommended, those of them in the training slices, and all of the latter."""
    shown = top.select("item_id").distinct().withColumn("shown", F.lit(1))
    both = shown.join(data.train_items.withColumn("known", F.lit(1)), "item_id", "full_outer")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return both.agg(total(F.col("shown"), "n_items_recommended"), total(F.col("shown") * F.col("known"), "n_covered"), total(F.col("known"), "n_train_items")).withColumn("coverage", F.round(F.col("n_covered") / F.col("n_train_items"), 6))


def per_user(top: DataFrame, data: EvalData, catalog: DataFrame | None = None, auc: DataFrame | None = None, k: int = K) -> DataFrame:
    """user_metrics() with auc (user_id, auc) where given, without users who have seen the whole catalogue."""
    users = user_metrics(top, data, k)
    if auc is not None:
        users = users.join(auc, "user_id", "left")
    return users if catalog is None else users.join(skipped_users(data, catalog), "user_id", "left_anti")


def evaluate(scores: DataFrame, data: EvalData, drawn: DataFrame | None = None, k: int = K, catalog: DataFrame | None = None) -> DataFrame:
    """One row of means over the population; AUC where negatives are given. Scores are validated();
    with a catalogue, users who have seen all of it are left out."""
    masked = mask_seen(validated(scores), data.seen)
    users = per_user(top_k(masked, k), data, catalog, None if drawn is None else user_auc(masked, data, drawn), k)
    return _means(users, drawn is not None)


def _means(users: DataFrame, auc: bool) -> DataFrame:
    names = ["recall", "ndcg", *(["auc"] if auc else [])]
    return users.agg(F.count("*").alias("n_users"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def summary(top: DataFrame, data: EvalData, splits: DataFrame, catalog: DataFrame, auc: DataFrame | None = None, scheme: str = "user", target: str = "val", k: int = K) -> DataFrame:
    """One row about a top-k list: the means over the users who count, coverage by what they were
    shown, and who is left out: skipped_all_seen of the population, and users of the log without
    a positive in train or in the target slice."""
    skipped = skipped_users(data, catalog)
    users = _means(per_user(top, data, catalog, auc, k), auc is not None)
    shown = coverage(top.join(skipped, "user_id", "left_anti"), data)
    label = F.col(f"split_{scheme}")
    has = lambda name: F.max((positive() & (label == name)).cast("int"))
    log = splits.groupBy("user_id").agg(has("train").alias("t"), has(target).alias("h"))
    out = log.agg(F.count(F.when(F.col("t") == 0, 1)).alias("excluded_no_train_positive"), F.count(F.when((F.col("t") == 1) & (F.col("h") == 0), 1)).alias("excluded_no_target_positive"))
    left = skipped.join(data.population, "user_id", "left_semi").agg(F.count("*").alias("skipped_all_seen"))
    # Rows of one each.
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(users).join(one(shown), "__one").join(one(left), "__one").join(one(out), "__one").drop("__one")


def subsample(users: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n users in the order of a hash."""
    return users.withColumn("__h", key_hash(seed, "user_id")).orderBy("__h", "user_id").limit(n).drop("__h")


def oracle_scores(data: EvalData) -> DataFrame:
    """The best that can be had: what is relevant, and nothing else."""
    return data.relevant.withColumn("score", F.lit(1.0))


def random_scores(pairs: DataFrame, seed: int = 0) -> DataFrame:
    return pairs.select("user_id", "item_id", (key_hash(seed, "user_id", "item_id") / F.lit(float(1 << 32))).alias("score"))


def recall_ceiling(candidates: DataFrame, data: EvalData, ks: tuple[int, ...] = CEILINGS) -> DataFrame:
    """k, ceiling: the mean share of a user's relevant items among the first k candidates (with rank)."""
    found = data.relevant.join(candidates.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    users = found.groupBy("user_id").agg(*[(F.count(F.when(F.col("rank") <= k, 1)) / F.count("*")).alias(f"k{k}") for k in ks])
    means = users.agg(*[F.round(F.avg(f"k{k}"), 6).alias(f"k{k}") for k in ks])
    return means.select(F.expr(f"stack({len(ks)}, {', '.join(f'{k}L, k{k}' for k in ks)}) as (k, ceiling)"))


