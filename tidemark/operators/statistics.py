"""Comparisons of runs: bootstrap intervals, breakdowns, seeds, equality of outputs, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import key_hash
from .splits import HOUR, user_bounds

REPLICATES, REPORT_REPLICATES = 1000, 2000
MARGIN = 0.003
#: Upper ends of the counts 0, 1, 2... of a Poisson(1) draw, on [0, 1).
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217]


def poisson_weight(u: Column) -> Column:
    """How often a unit occurs in a resample, by a uniform number: a Poisson(1) count."""
    out = F.lit(len(_POISSON))
    for n, end in reversed(list(enumerate(_POISSON))):
        out = F.when(u < end, n).otherwise(out)
    return out


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """user_id, diff = a - b; raises unless both cover the same users, once each."""
    both = a.select("user_id", F.col(metric).alias("x"), F.lit(1).alias("l")).join(b.select("user_id", F.col(metric).alias("y"), F.lit(1).alias("r")), "user_id", "full_outer").cache()
    lost = both.where("l is null or r is null").limit(1).count()
    if lost or both.groupBy("user_id").count().where("count > 1").limit(1).count():
        raise ValueError("both runs must cover exactly the same users")
    return both.select("user_id", (F.col("x") - F.col("y")).alias("diff"))


def _replicates(values: DataFrame, value: str, n: int, seed: int) -> DataFrame:
    """replicate, mean: weighted means, each weight from a hash of seed, replicate and user."""
    u = key_hash(seed, "replicate", "user_id") / F.lit(float(1 << 32))
    rows = values.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", poisson_weight(u))
    # A resample of few units can be empty: it has no mean.
    return rows.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("mean"))


def bootstrap(diffs: DataFrame, value: str = "diff", n: int = REPLICATES, seed: int = 0) -> DataFrame:
    """One row: mean, and the 2.5 and 97.5 percentiles of resampled means. Tasks sum up their
    users for each replicate, so a replicate and task is a row of the shuffle, whatever the users."""
    q = F.expr("percentile(mean, array(0.025D, 0.975D))")
    ends = _replicates(diffs, value, n, seed).agg(q.alias("q"))
    mean = diffs.agg(F.avg(value).alias("m")).first()["m"]
    return ends.select(F.round(F.lit(mean), 6).alias("mean"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


def ablation(runs: dict[str, DataFrame], headline: str, metric: str = "ndcg", n: int = REPORT_REPLICATES, seed: int = 0) -> DataFrame:
    """model, mean, diff, lo, hi: every run (user_id, metric) against the headline's, on the same users."""
    out = None
    for name, run in runs.items():
        row = bootstrap(paired(run, runs[headline], metric), n=n, seed=seed).withColumnRenamed("mean", "diff")
        value = run.agg(F.round(F.avg(metric), 6).alias("mean"))
        row = row.select(F.lit(name).alias("model"), F.lit(value.first()["mean"]).alias("mean"), "diff", "lo", "hi")
        out = row if out is None else out.unionByName(row)
    return out


def ratio_interval(a: DataFrame, b: DataFrame, metric: str, n: int = REPORT_REPLICATES, seed: int = 0) -> DataFrame:
    """One row: the ratio of means of two independent populations, with its resampled percentiles."""
    x = _replicates(a, metric, n, seed).withColumnRenamed("mean", "x")
    y = _replicates(b, metric, n, seed + 1).withColumnRenamed("mean", "y")
    q = F.expr("percentile(x / y, array(0.025D, 0.975D))")
    means = [d.agg(F.avg(metric)).first()[0] for d in (a, b)]
    return x.join(y, "replicate").agg(q.alias("q")).select(F.round(F.lit(means[0] / means[1]), 6).alias("ratio"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


def boundaries(splits: DataFrame, scheme: str = "user", target: str = "test") -> DataFrame:
    """user_id, gap, boundary: seconds from the last training row to the first target row, as class."""
    first = F.col(f"{target}_lo")
    last = F.col("train_hi") if target == "val" else F.greatest("train_hi", "val_hi")
    gap = user_bounds(splits, scheme).select("user_id", (first - last).alias("gap")).where("gap is not null")
    return gap.withColumn("boundary", F.when(F.col("gap") == 0, "same_second").when(F.col("gap") <= HOUR, "within_1h").otherwise("over_1h"))


def breakdown(per_user: DataFrame, classes: DataFrame, metric: str, by: str = "boundary") -> DataFrame:
    """class, n_users, mean of the metric in each class and over all, by grouping sets."""
    rows = per_user.join(classes.select("user_id", by), "user_id")
    out = rows.groupingSets([[by], []], by).agg(F.grouping(by).alias("all"), F.count("*").alias("n_users"), F.round(F.avg(metric), 6).alias("mean"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col(by)).alias("class"), "n_users", "mean")


def pivoted(rows: DataFrame, by: str, columns: str, values: list[str], metric: str) -> DataFrame:
    return rows.groupBy(by).pivot(columns, values).agg(F.first(metric))


def mean_over_seeds(runs: DataFrame, metric: str) -> DataFrame:
    """model, user_id, mean over seeds; a second mean over users is a model's figure."""
    return runs.groupBy("model", "user_id").agg(F.avg(metric).alias(metric))


def seed_summary(results: DataFrame, metric: str) -> DataFrame:
    """model, median, lowest, highest, n_seeds of per-seed results."""
    return results.groupBy("model").agg(F.expr(f"percentile({metric}, 0.5D)").alias("median"), F.min(metric).alias("lowest"), F.max(metric).alias("highest"), F.countDistinct("seed").alias("n_seeds"))


def same_output(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """One row: rows of a not in b and of b not in a, counted with multiplicity, floats rounded."""
    rounded = lambda d: d.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(d.dtypes)])
    x, y = rounded(a), rounded(b)
    keyed = x.withColumn("__n", F.lit(1)).unionByName(y.withColumn("__n", F.lit(-1))).groupBy(*x.columns).agg(F.sum("__n").alias("n"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    return keyed.agg(total(F.greatest("n", F.lit(0)), "only_left"), total(F.greatest(-F.col("n"), F.lit(0)), "only_right"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """user_id, share of k items that two top-k lists have in common, and whether in one order."""
    both = a.select("user_id", "item_id", F.col("rank").alias("x")).join(b.select("user_id", "item_id", F.col("rank").alias("y")), ["user_id", "item_id"])
    return both.groupBy("user_id").agg((F.count("*") / F.lit(k)).alias("share"), (F.count(F.when(F.col("x") == F.col("y"), 1)) == k).alias("same_order"))


def verdicts(figures: DataFrame, claims: list[tuple[str, str, str, float]]) -> DataFrame:
    """claim, held: each claim (name, better model, worse model, least difference) against figures (model, value)."""
    spark = figures.sparkSession
    c = spark.createDataFrame(claims, "claim string, better string, worse string, least double")
    f = lambda p: figures.select(F.col("model").alias(p), F.col("value").alias(f"{p}_value"))
    df = c.join(f("better"), "better", "left").join(f("worse"), "worse", "left")
    return df.select("claim", F.round(F.col("better_value") - F.col("worse_value"), 6).alias("difference"), F.coalesce(F.col("better_value") - F.col("worse_value") > F.col("least"), F.lit(False)).alias("held"))


def publish_gate(candidate: DataFrame, live: DataFrame | None, metric: str = "ndcg", margin: float = MARGIN) -> DataFrame:
    """One row: both means, their difference, and publish: only if it is above the margin, or none is live."""
    own = candidate.agg(F.avg(metric).alias("candidate"))
    old = live.agg(F.avg(metric).alias("live")) if live is not None else candidate.sparkSession.range(1).select(F.lit(None).cast("double").alias("live"))
    x, y = own.first()["candidate"], old.first()["live"]  # two numbers
    spark = candidate.sparkSession
    return spark.range(1).select(F.round(F.lit(x), 6).alias("candidate"), F.round(F.lit(y).cast("double"), 6).alias("live"), F.lit(margin).alias("margin"), F.lit(y is None or (x is not None and x > y + margin)).alias("publish"))


def latency_percentiles(timings: DataFrame) -> DataFrame:
    """stage, p50, p90, p99, most of a frame stage, ms."""
    q = F.expr("percentile(ms, array(0.5D, 0.9D, 0.99D))")
    return timings.groupBy("stage").agg(q.alias("q"), F.max("ms").alias("most")).select("stage", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "most")
