import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tidemark.operators import evaluation as ev
from tidemark.operators import models as mo
from tidemark.operators import splits as sp


@pytest.fixture(scope="module")
def train(spark):
    splits = sp.build_splits(spark.createDataFrame(fixtures.log(), fixtures.COLUMNS))
    return sp.training_set(splits, "train").cache()


@pytest.fixture(scope="module")
def dense(train):
    """(users, items, 0/1 matrix) of the positives."""
    rows = mo.likes(train).toPandas()
    users, items = np.unique(rows.user_id), np.arange(1, 41)
    x = np.zeros((len(users), 40))
    x[np.searchsorted(users, rows.user_id), rows.item_id - 1] = 1
    return users, items, x


def kept(x, least):
    return np.flatnonzero(x.sum(0) >= least)


@pytest.mark.parametrize("k,shrink", [(1, 0.0), (3, 0.0), (5, 10.0), (100, 1.0)])
def test_neighbours_equal_brute_force(train, dense, k, shrink):
    _, items, x = dense
    keep = kept(x, 2)
    g = x[:, keep].T @ x[:, keep]
    s = g / (np.sqrt(np.outer(np.diag(g), np.diag(g))) + shrink)
    np.fill_diagonal(s, 0)
    want = {}
    for c in range(len(keep)):
        order = sorted((i for i in range(len(keep)) if s[i, c] > 0), key=lambda i: (-s[i, c], i))[:k]
        want |= {(items[keep[i]], items[keep[c]]): s[i, c] for i in order}
    got = {(r.i, r.j): r.s for r in mo.knn_similarity(mo.item_gram(mo.likes(train), 2), k, shrink).collect()}
    assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))


def test_ease_is_ridge_without_self(train, dense):
    _, items, x = dense
    keep = kept(x, 2)
    a = x[:, keep]
    got = {(r.i, r.j): r.s for r in mo.ease_weights(mo.item_gram(mo.likes(train), 2), 3.0).collect()}
    for j in range(len(keep)):
        others = [i for i in range(len(keep)) if i != j]
        b = np.linalg.solve(a[:, others].T @ a[:, others] + 3.0 * np.eye(len(others)), a[:, others].T @ a[:, j])
        assert np.allclose([got.get((items[keep[i]], items[keep[j]]), 0.0) for i in others], b, atol=1e-8)
    with pytest.raises(ValueError):
        mo.ease_weights(mo.item_gram(mo.likes(train), 1), 3.0, max_items=3)


def test_dense_and_joined_scores_agree(train):
    liked = mo.likes(train)
    weights = mo.ease_weights(mo.item_gram(liked, 2), 3.0).cache()
    seen = train.select("user_id", "item_id")
    a = {(r.user_id, r["rank"]): r.item_id for r in mo.dense_top_k(liked, weights, seen, 5).collect()}
    b = {(r.user_id, r["rank"]): r.item_id for r in ev.top_k(ev.mask_seen(mo.history_scores(liked, weights), seen), 5).collect()}
    assert a == b


def test_popular_list_equals_brute_force(train, spark):
    catalog = spark.createDataFrame([(i,) for i in range(1, 41)], "item_id long")
    scores = mo.popularity(mo.likes(train), catalog)
    assert scores.count() == 40 and scores.where("item_id = 40").first().score == 0.0
    users = train.select("user_id").distinct().union(spark.createDataFrame([(99,)], "user_id long"))
    seen = train.select("user_id", "item_id")
    got = mo.popular_top_k(scores, users, seen, 6)
    full = ev.top_k(ev.mask_seen(users.crossJoin(scores), seen), 6)
    assert {(r.user_id, r["rank"], r.item_id) for r in got.collect()} == {(r.user_id, r["rank"], r.item_id) for r in full.collect()}


def test_zero_scores_fill_the_list(train, dense):
    users, items, x = dense
    liked = mo.likes(train)
    keep = kept(x, 3)
    sim = mo.knn_similarity(mo.item_gram(liked, 3), 2, 0.0)
    seen = train.select("user_id", "item_id")
    got = ev.top_k(ev.mask_seen(mo.fill_zero(mo.history_scores(liked, sim), mo.kept_items(liked, 3), liked.select("user_id").distinct(), seen, 8), seen), 8).collect()
    s = np.zeros((40, 40))
    for r in sim.collect():
        s[r.i - 1, r.j - 1] = r.s
    own = {(r.user_id, r.item_id) for r in seen.collect()}
    for u, user in enumerate(users):
        score = x[u] @ s
        want = sorted((i for i in keep if (user, items[i]) not in own), key=lambda i: (-round(score[i], 12), i))[:8]
        assert [items[i] for i in want] == [r.item_id for r in sorted((r for r in got if r.user_id == user), key=lambda r: r["rank"])]


def test_als_factors_and_lists(train):
    model = mo.als_factors(mo.likes(train), rank=4, seed=1)
    assert {r.id for r in model.itemFactors.collect()} == {r.item_id for r in mo.likes(train).select("item_id").distinct().collect()}
    assert model.itemFactors.first().features.__len__() == 4
    seen = train.select("user_id", "item_id")
    top = mo.als_top_k(model, train.select("user_id").distinct(), seen, 5)
    assert top.join(seen, ["user_id", "item_id"]).count() == 0
    assert top.groupBy("user_id").agg(F.max("rank").alias("n")).where("n > 5").count() == 0


def test_recent_history(train):
    got = {(r.user_id, r.item_id) for r in mo.recent_history(train, 2).collect()}
    rows = train.where(sp.positive()).collect()
    for u in {r.user_id for r in rows}:
        own = sorted((r for r in rows if r.user_id == u), key=lambda r: (-r.ts, -r.item_id))[:2]
        assert {(u, r.item_id) for r in own} == {p for p in got if p[0] == u}


def test_blocked_inverse_equals_the_whole(train):
    gram = mo.item_gram(mo.likes(train), 1).cache()
    want = {(r.i, r.j): r.s for r in mo.ease_weights(gram, 3.0).collect()}
    for block in (7, 16, 100):
        got = {(r.i, r.j): r.s for r in mo.ease_weights_blocked(gram, 3.0, block).collect()}
        assert all(abs(got.get(p, 0.0) - want.get(p, 0.0)) < 1e-9 for p in got.keys() | want.keys())


def test_more_items_than_one_matrix_takes(train, monkeypatch):
    liked = mo.likes(train)
    seen = train.select("user_id", "item_id")
    gram = mo.item_gram(liked, 1).cache()
    want = {(r.user_id, r["rank"]): r.item_id for r in mo.ease_top_k(liked, mo.ease(gram, 3.0), seen, 5).collect()}
    monkeypatch.setattr(mo, "MAX_DENSE", 3)
    assert {(r.user_id, r["rank"]): r.item_id for r in mo.ease_top_k(liked, mo.ease(gram, 3.0), seen, 5).collect()} == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_a_users_items_give_the_same_gram(train, dense, monkeypatch, block):
    _, items, x = dense
    monkeypatch.setattr(mo, "BLOCK", block)
    g = x.T @ x
    got = {(r.i, r.j): r.n for r in mo.item_gram(mo.likes(train), 1).collect()}
    assert got == {(items[a], items[b]): g[a, b] for a in range(40) for b in range(40) if g[a, b]}


def test_als_lists_do_not_depend_on_other_users(train):
    model = mo.als_factors(mo.likes(train), rank=4, seed=1)
    seen, users = train.select("user_id", "item_id"), train.select("user_id").distinct()
    rows = lambda u: {(r.user_id, r["rank"], r.item_id) for r in mo.als_top_k(model, u, seen, 5).collect()}
    every = rows(users)
    for user in (1, 7):
        assert rows(users.where(F.col("user_id") == user)) == {r for r in every if r[0] == user}
    assert mo.als_top_k(model, users.limit(0), seen, 5).count() == 0


@pytest.mark.parametrize("asked", [1, 40])
def test_pair_scores_of_more_items_than_one_matrix_takes(spark, train, monkeypatch, asked):
    liked = mo.likes(train)
    weights = mo.knn_similarity(mo.item_gram(liked, 1), 3, 0.0).cache()
    pairs = train.select("user_id").distinct().join(spark.range(1, asked + 1).withColumnRenamed("id", "item_id"))
    want = {(r.user_id, r.item_id): r.score for r in mo.ease_pair_scores(liked, weights, pairs).collect()}
    monkeypatch.setattr(mo, "MAX_DENSE", 3)
    got = {(r.user_id, r.item_id): r.score for r in mo.ease_pair_scores(liked, weights, pairs).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[p] - want[p]) < 1e-9 for p in want)
