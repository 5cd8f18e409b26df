"""Models: popularity, item neighbours, EASE, implicit ALS, and scoring by history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_per_group
from ..sources import shared_path, written
from .evaluation import K, mask_seen, numbered, top_k
from .splits import positive

#: A dense item matrix of at most so many items is inverted on the driver; a larger one in blocks.
MAX_DENSE = 4_000
#: Items on a side of a block, of a user's positives and of a dense matrix.
BLOCK = 1_000
#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def likes(train: DataFrame) -> DataFrame:
    """user_id, item_id of the positives."""
    return train.where(positive()).select("user_id", "item_id").distinct()


# ---- popularity

def popularity(liked: DataFrame, catalog: DataFrame) -> DataFrame:
    """item_id, score: positives of every item of the catalogue, 0 without any."""
    n = liked.groupBy("item_id").agg(F.count("*").alias("n"))
    return catalog.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def popular_list(scores: DataFrame, limit: int) -> DataFrame:
    """The first `limit` items with their place from 1: one bounded sort."""
    top = scores.orderBy(F.col("score").desc(), "item_id").limit(limit)
    return first_per_group(top.withColumn("__all", F.lit(0)), ["__all"], [F.col("score").desc(), F.col("item_id")], limit, "place").drop("__all")


def popular_top_k(scores: DataFrame, users: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """user_id, item_id, score, rank: each user's k most popular unseen items.

    Among a user's first k + n_seen items at least k are unseen: no pair beyond them is made.
    """
    counts = users.select("user_id").join(seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))
    most = (counts.agg(F.max("n")).first()[0] or 0) + k
    listed = popular_list(scores, most)
    # Everyone starts with the same places: the list travels where its length, which is known, allows.
    listed = F.broadcast(listed) if most <= BROADCAST_ROWS else listed
    walk = counts.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") + k)).alias("place")).join(listed, "place")
    open_ = walk.join(seen, ["user_id", "item_id"], "left_anti")
    return first_per_group(open_, ["user_id"], [F.col("place")], k).select("user_id", "item_id", "score", "rank")


# ---- item neighbours

def kept_items(liked: DataFrame, min_positives: int) -> DataFrame:
    """item_id, n of items with enough positives."""
    return liked.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_positives)


def item_gram(liked: DataFrame, min_positives: int) -> DataFrame:
    """i, j, n: users who like both, the diagonal included, for kept items; zeros are absent.

    A user with many positives is split into blocks of some BLOCK items, and pairs of blocks are
    keys of their own: no task gets all the pairs of one user.
    """
    own = liked.join(kept_items(liked, min_positives).select("item_id"), "item_id", "left_semi")
    n = F.count("*").over(Window.partitionBy("user_id"))
    own = own.select("user_id", "item_id", F.ceil(n / F.lit(BLOCK)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("item_id"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    a = own.select("user_id", F.col("block").alias("x"), F.col("other").alias("y"), F.col("item_id").alias("i"))
    b = own.select("user_id", F.col("other").alias("x"), F.col("block").alias("y"), F.col("item_id").alias("j"))
    # Half of the pairs, then mirrored: the matrix is symmetric.
    upper = a.join(b, ["user_id", "x", "y"]).where("i <= j").groupBy("i", "j").agg(F.count("*").alias("n"))
    return upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def knn_similarity(gram: DataFrame, k: int, shrink: float) -> DataFrame:
    """i, j, s: for each item j the k items i most similar to it, ties by i."""
    diagonal = gram.where("i = j").select(F.col("i").alias("item"), F.sqrt(F.col("n").cast("double")).alias("root"))
    pairs = gram.where("i <> j").join(diagonal.withColumnsRenamed({"item": "i", "root": "a"}), "i").join(diagonal.withColumnsRenamed({"item": "j", "root": "b"}), "j")
    pairs = pairs.select("i", "j", (F.col("n") / (F.col("a") * F.col("b") + F.lit(float(shrink)))).alias("s"))
    return first_per_group(pairs, ["j"], [F.col("s").desc(), F.col("i")], k).drop("rank")


def history_scores(history: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, item_id, score: sums of weights (i, j, s) over the items i of a history."""
    pairs = history.select("user_id", F.col("item_id").alias("i")).join(weights, "i")
    return pairs.groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum("s").alias("score"))


def fill_zero(scores: DataFrame, kept: DataFrame, users: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """scores, and zeros for so many kept items that each user's k best are right.

    Kept items without a score have score 0 and tie by id: the first k + n_known + n_seen ids hold k of them.
    """
    n = scores.groupBy("user_id").agg(F.count("*").alias("n1")).join(seen.groupBy("user_id").agg(F.count("*").alias("n2")), "user_id", "full_outer")
    need = users.select("user_id").join(n, "user_id", "left").select("user_id", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)) + k).alias("need"))
    most = need.agg(F.max("need")).first()[0] or k
    listed = popular_list(kept.select("item_id", F.lit(0.0).alias("score")), most)
    zeros = need.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need"))).alias("place")).join(listed, "place").select("user_id", "item_id", "score")
    zeros = zeros.join(scores.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return scores.unionByName(zeros)


def recent_history(train: DataFrame, n: int) -> DataFrame:
    """user_id, item_id of each user's last n positives."""
    return first_per_group(train.where(positive()), ["user_id"], [F.col("ts").desc(), F.col("item_id").desc()], n).select("user_id", "item_id")


# ---- EASE

def ease_weights(gram: DataFrame, lam: float, max_items: int = MAX_DENSE) -> DataFrame:
    """i, j, s: the closed-form item weights, zero on the diagonal.

    The inverse isn't relational: the Gram matrix of the kept items, whose number is bounded, is
    inverted by numpy on the driver. More items are refused (raise min_positives).
    """
    spark = gram.sparkSession
    ids = [r[0] for r in gram.where("i = j").select("i").orderBy("i").limit(max_items + 1).collect()]
    if len(ids) > max_items:
        raise ValueError(f"more than {max_items} items: raise min_positives")
    place = {x: n for n, x in enumerate(ids)}
    rows = gram.toPandas()
    g = np.zeros((len(ids), len(ids)))
    g[rows["i"].map(place), rows["j"].map(place)] = rows["n"]
    g[np.diag_indices(len(ids))] += lam
    p = np.linalg.inv(g)
    b = -p / np.diag(p)[None, :]
    b[np.diag_indices(len(ids))] = 0
    i, j = np.nonzero(b)
    own = np.array(ids, np.int64)
    return spark.createDataFrame(pd.DataFrame({"i": own[i], "j": own[j], "s": b[i, j]}), "i long, j long, s double")


def ease_weights_blocked(gram: DataFrame, lam: float, block: int = BLOCK) -> DataFrame:
    """ease_weights() of any number of items: a matrix of dense blocks, inverted in place.

    Gauss-Jordan by blocks: in step k the block on the diagonal is inverted, row and column k
    are multiplied by it, and every other block loses their product. The matrix is positive
    definite, so no pivots are searched. Each step is a job over all blocks, joined with row
    and column k, and written; a task holds a few blocks of block * block doubles.
    """
    spark = gram.sparkSession
    places = written(numbered(gram.where("i = j").select(F.col("i").alias("item_id"))), "ease-places")
    n = places.count()
    size = lambda b: min(block, n - b * block)
    steps = -(-n // block)
    row, col = (places.select(F.col("item_id").alias(c), F.col("place").alias(p)) for c, p in (("i", "r"), ("j", "c")))
    cells = gram.join(row, "i").join(col, "j").select((F.col("r") / block).cast("int").alias("bi"), (F.col("c") / block).cast("int").alias("bj"), F.pmod("r", F.lit(block)).alias("r"), F.pmod("c", F.lit(block)).alias("c"), F.col("n").cast("double").alias("x"))
    # Every block is there, if only with zeros.
    grid = spark.range(steps * steps).select((F.col("id") / steps).cast("int").alias("bi"), (F.col("id") % steps).cast("int").alias("bj"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("x"))

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        m = np.zeros((size(bi), size(bj)))
        np.add.at(m, (pdf["r"].to_numpy(), pdf["c"].to_numpy()), pdf["x"].to_numpy())
        if bi == bj:
            m[np.diag_indices(len(m))] += lam
        return pd.DataFrame({"bi": [bi], "bj": [bj], "m": [m.tobytes()]})

    schema = "bi int, bj int, m binary"
    blocks = written(cells.unionByName(grid).groupBy("bi", "bj").applyInPandas(dense, schema), "ease-blocks")
    for k in range(steps):

        def step(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            inverse: np.ndarray | None = None
            for batch in batches:
                out = []
                for bi, bj, own, left, up, pivot in batch.itertuples(index=False):
                    if inverse is None:
                        inverse = np.linalg.inv(np.frombuffer(pivot).reshape(size(k), size(k)))
                    shaped = lambda raw, a, b: np.frombuffer(raw).reshape(size(a), size(b))
                    if bi == k and bj == k:
                        m = inverse
                    elif bi == k:
                        m = inverse @ shaped(own, k, bj)
                    elif bj == k:
                        m = -shaped(own, bi, k) @ inverse
                    else:
                        m = shaped(own, bi, bj) - shaped(left, bi, k) @ (inverse @ shaped(up, k, bj))
                    out.append((bi, bj, np.ascontiguousarray(m).tobytes()))
                yield pd.DataFrame(out, columns=["bi", "bj", "m"])

        left = blocks.where(F.col("bj") == k).select("bi", F.col("m").alias("left"))
        up = blocks.where(F.col("bi") == k).select("bj", F.col("m").alias("up"))
        pivot = blocks.where((F.col("bi") == k) & (F.col("bj") == k)).select(F.col("m").alias("pivot"))
        joined = blocks.join(left, "bi").join(up, "bj").join(F.broadcast(pivot)).select("bi", "bj", "m", "left", "up", "pivot")  # one row of one block
        blocks = written(joined.mapInPandas(step, schema), "ease-blocks")

    diagonal = blocks.where("bi = bj").select("bj", F.col("m").alias("own"))

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bi, bj, raw, own in batch.itertuples(index=False):
                d = np.diag(np.frombuffer(own).reshape(size(bj), size(bj)))
                b = -np.frombuffer(raw).reshape(size(bi), size(bj)) / d[None, :]
                if bi == bj:
                    b[np.diag_indices(len(b))] = 0
                r, c = np.nonzero(b)
                yield pd.DataFrame({"r": r + bi * block, "c": c + bj * block, "s": b[r, c]})

    pairs = blocks.join(diagonal, "bj").select("bi", "bj", "m", "own").mapInPandas(weights, "r long, c long, s double")
    return pairs.join(row, "r").join(col, "c").select("i", "j", "s")


def ease(gram: DataFrame, lam: float) -> DataFrame:
    """The item weights, whatever the number of items: one inverse on the driver, or one in blocks."""
    few = gram.where("i = j").limit(MAX_DENSE + 1).count() <= MAX_DENSE
    return ease_weights(gram, lam) if few else ease_weights_blocked(gram, lam)


def ease_top_k(history: DataFrame, weights: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """user_id, item_id, score, rank by EASE weights: in one matrix for few items, else joined."""
    if weights.select("j").distinct().limit(MAX_DENSE + 1).count() <= MAX_DENSE:
        return dense_top_k(history, weights, seen, k)
    return top_k(mask_seen(history_scores(history, weights), seen), k)


def dense_top_k(history: DataFrame, weights: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """user_id, item_id, score, rank of history_scores() without seen items, for dense weights.

    The weights of a bounded number of items travel to the tasks once, as one matrix; each task
    scores its users in blocks, and only k rows a user leave it.
    """
    spark = history.sparkSession
    if weights.select("i").union(weights.select("j")).distinct().limit(MAX_DENSE + 1).count() > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} items")
    shared = spark.sparkContext.broadcast(_matrix(weights))
    users = history.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("own"))
    users = users.join(seen.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("seen")), "user_id", "left")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                x, hide = np.zeros((len(part), len(ids))), np.zeros((len(part), len(ids)), bool)
                for r, (own, gone) in enumerate(zip(part["own"], part["seen"], strict=True)):
                    x[r, np.flatnonzero(np.isin(ids, own))] = 1
                    if gone is not None:
                        hide[r] = np.isin(ids, gone)
                s = np.where(hide, -np.inf, x @ matrix)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                r, c = np.nonzero(best > -np.inf)
                yield pd.DataFrame({"user_id": part["user_id"].to_numpy()[r], "item_id": ids[order[r, c]], "score": best[r, c], "rank": c + 1})

    return users.mapInPandas(score, "user_id long, item_id long, score double, rank long")


def ease_pair_scores(history: DataFrame, weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, item_id, score of the given pairs alone: sums of weights over a user's history.
    Items without weights can't be scored, and are absent."""
    spark = history.sparkSession
    own = history.groupBy("user_id").agg(F.collect_set("item_id").alias("own"))
    known = weights.select(F.col("j").alias("item_id")).distinct()
    asked = pairs.select("user_id", "item_id").distinct()
    if known.limit(MAX_DENSE + 1).count() > MAX_DENSE:
        # Of the weights, those of items that nobody asks for are dropped first. Then histories meet
        # the weights of their items, or the items that their users ask for: whichever are fewer.
        wanted = weights.select("i", F.col("j").alias("item_id"), "s").join(asked.select("item_id").distinct(), "item_id", "left_semi")
        mean = lambda df, c: df.agg((F.count("*") / F.greatest(F.count_distinct(c), F.lit(1))).alias("n")).first()["n"]
        if mean(wanted, "i") <= mean(asked, "user_id"):
            sums = history_scores(history.join(asked.select("user_id").distinct(), "user_id", "left_semi"), wanted.withColumnRenamed("item_id", "j")).join(asked, ["user_id", "item_id"], "left_semi")
        else:
            rows = asked.join(history.select("user_id", F.col("item_id").alias("i")), "user_id").join(wanted, ["i", "item_id"])
            sums = rows.groupBy("user_id", "item_id").agg(F.sum("s").alias("score"))
        zero = asked.join(known, "item_id", "left_semi").join(history.select("user_id").distinct(), "user_id", "left_semi")
        return zero.join(sums, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    shared = spark.sparkContext.broadcast(_matrix(weights))
    lists = asked.groupBy("user_id").agg(F.collect_list("item_id").alias("asked")).join(own, "user_id")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            for user, asked, own in zip(batch["user_id"], batch["asked"], batch["own"], strict=True):
                asked = asked[np.isin(asked, ids)]
                row = matrix[np.searchsorted(ids, own[np.isin(own, ids)])][:, np.searchsorted(ids, asked)].sum(0)
                yield pd.DataFrame({"user_id": np.full(len(asked), user), "item_id": asked, "score": row})

    return lists.select("user_id", "asked", "own").mapInPandas(score, "user_id long, item_id long, score double")


def _matrix(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The items of weights, and the weights as a dense matrix."""
    rows = weights.toPandas()
    ids = np.unique(np.concatenate([rows["i"].to_numpy(), rows["j"].to_numpy()]))
    matrix = np.zeros((len(ids), len(ids)))
    matrix[np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])] = rows["s"]
    return ids, matrix


# ---- implicit ALS

def als_factors(liked: DataFrame, rank: int = 8, reg: float = 0.1, alpha: float = 5.0, max_iter: int = 5, seed: int = 42):
    """A fitted implicit model: positives only, each with label 1."""
    from pyspark.ml.recommendation import ALS

    spark = liked.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "als"))
    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="label", implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=max_iter, seed=seed, numUserBlocks=10, numItemBlocks=10, checkpointInterval=5, coldStartStrategy="nan")
    return als.fit(liked.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.lit(1.0).alias("label")))


def als_top_k(model, users: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """user_id, item_id, score, rank. Items without a factor can't be scored; users without one score 0.

    A user gets k items more than it has seen, by blocked matrix products inside the tasks. Users
    are asked for by classes of that number, up to the next power of two, so that one user with very
    many seen items makes no long lists for the others.
    """
    counts = users.select("user_id").distinct().join(seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left")
    counts = counts.select("user_id", F.ceil(F.log2(F.coalesce("n", F.lit(0)) + F.lit(k))).cast("int").alias("class")).cache()
    rows = None
    for c in sorted(r["class"] for r in counts.select("class").distinct().collect()):  # some thirty at most
        found = model.recommendForUserSubset(counts.where(F.col("class") == c).select(F.col("user_id").cast("int").alias("user_id")), 1 << c)
        part = found.select(F.col("user_id").cast("bigint"), F.explode("recommendations").alias("r")).select("user_id", F.col("r.item_id").cast("bigint").alias("item_id"), F.col("r.rating").cast("double").alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = users.sparkSession.createDataFrame([], "user_id long, item_id long, score double")
    lost = users.select("user_id").join(model.userFactors.select(F.col("id").cast("bigint").alias("user_id")), "user_id", "left_anti")
    known = model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"))
    rows = rows.join(seen, ["user_id", "item_id"], "left_anti")
    zero = popular_top_k(known.withColumn("score", F.lit(0.0)), lost, seen.join(lost, "user_id", "left_semi"), k).drop("rank")
    return first_per_group(rows.unionByName(zero), ["user_id"], [F.col("score").desc(), F.col("item_id")], k)
