"""The feature pipeline that is timed, and its inputs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import key_hash
from ..operators.features import feature_tables
from ..operators.splits import per_user_split, training_set


def whole_users(ratings: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """The ratings of whole users in the order of a hash, up to the user that reaches the target.

    Users are put in 4096 bins of the hash first. Bins are summed up in order, and only in the
    one that crosses the target are single users.
    """
    users = ratings.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("h", key_hash(seed, "user_id")).withColumn("bin", F.shiftright("h", 20))
    bins = users.groupBy("bin").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("bin")) - F.col("n")  # 4096 rows at most
    bins = bins.select("bin", before.alias("before"))
    inner = F.sum("n").over(Window.partitionBy("bin").orderBy("h", "user_id")) - F.col("n")
    kept = users.join(F.broadcast(bins.where(F.col("before") < target)), "bin").withColumn("earlier", F.col("before") + inner).where(F.col("earlier") < target)
    return ratings.join(kept.select("user_id"), "user_id", "left_semi")


def feature_pipeline(ratings: DataFrame, items: DataFrame, out: str) -> None:
    """Splits and the features of train, written as four Parquet tables.

    The splits are dealt by user: user features and shares take their partitioning, so only the
    items are shuffled again. Features read the splits back, which cuts the lineage. Their three
    tables are independent jobs, handed to the scheduler together.
    """
    spark = ratings.sparkSession
    per_user_split(ratings).select("user_id", "item_id", "rating", "ts", "split_user", "train_part").write.mode("overwrite").parquet(f"{out}/splits")
    train = training_set(spark.read.parquet(f"{out}/splits"), "train")
    tables = feature_tables(train, items)
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda t: t[1].write.mode("overwrite").parquet(f"{out}/{t[0]}"), tables.items()))
