import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tidemark.operators import evaluation as ev
from tidemark.operators import features as fe
from tidemark.operators import models as mo
from tidemark.operators import ranking as rk
from tidemark.operators import sequences as sq
from tidemark.operators import splits as sp
from tidemark.plans.ranker import LambdaMart
from tidemark.plans.retriever import TwoTower


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(fixtures.log(), fixtures.COLUMNS).cache()


@pytest.fixture(scope="module")
def context(spark, log):
    train = sp.training_set(sp.build_splits(log), "train").cache()
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(1, 26)], "item_id long, vector array<double>")
    return rk.Context(train, items, vectors)


@pytest.fixture(scope="module")
def cands(context):
    scores = mo.popularity(mo.likes(context.train), context.items)
    pairs = context.train.select("user_id").distinct().crossJoin(scores)
    return rk.candidates(pairs, context.train, 10).cache()


def test_feature_lists():
    assert (len(rk.BASE), len(rk.HEADLINE), len(rk.NO_EASE), len(rk.WITH_TIME), len(rk.PIT)) == (17, 15, 13, 17, 5)
    assert set(rk.BASE) - set(rk.HEADLINE) == set(rk.TIME) and set(rk.HEADLINE) - set(rk.NO_EASE) == {"ease_score", "ease_rank"}
    assert [f for f in rk.PIT_HEADLINE if f.startswith("pit_")] == rk.PIT[:3]


def test_candidates_are_unseen_and_in_order(context, cands):
    assert cands.join(context.train, ["user_id", "item_id"]).count() == 0
    for u in {r.user_id for r in cands.collect()}:
        own = sorted((r for r in cands.collect() if r.user_id == u), key=lambda r: r.retriever_rank)
        assert [r.retriever_rank for r in own] == list(range(len(own)))
        assert [(-r.retriever_score, r.item_id) for r in own] == sorted((-r.retriever_score, r.item_id) for r in own)


def test_point_in_time_equals_brute_force(log, cands, context):
    probes = cands.select("user_id", "item_id").join(rk.last_train_ts(context.train), "user_id")
    got = {(r.user_id, r.item_id): r for r in rk.point_in_time(probes, log).collect()}
    rows = fixtures.log()
    assert len(got) == probes.count()
    for p in probes.collect():
        own = [(r[3], r[2]) for r in rows if r[1] == p.item_id and r[3] < p.cutoff]
        r = got[p.user_id, p.item_id]
        assert math.isclose(r.pit_item_log_n, math.log1p(len(own)))
        assert math.isclose(r.pit_item_log_pos, math.log1p(sum(x >= 4 for _, x in own)))
        if own:
            assert math.isclose(r.pit_item_mean, sum(x for _, x in own) / len(own))
            assert math.isclose(r.pit_days_since_last, (p.cutoff - max(t for t, _ in own)) / 86400)
            assert math.isclose(r.pit_age_days, (p.cutoff - min(t for t, _ in own)) / 86400)
        else:
            assert r.pit_item_mean is r.pit_days_since_last is r.pit_age_days is None


def test_all_features_equal_plain_python(log, cands, context):
    ease = mo.history_scores(mo.likes(context.train), mo.ease_weights(mo.item_gram(mo.likes(context.train), 2), 5.0))
    got = {(r.user_id, r.item_id): r for r in rk.rank_features(cands, context, ease, log).collect()}
    assert len(got) == cands.count() and set(rk.BASE + rk.PIT) <= set(next(iter(got.values())).asDict())
    genres = {i: set(g.split("|")) for i, _, g in fixtures.items() if "(" not in g}
    liked = {}
    for r in context.train.where(sp.positive()).orderBy("ts", "item_id").collect():
        liked.setdefault(r.user_id, []).append(r.item_id)
    unit = {r.item_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in context.vectors.collect()}
    scores = {(r.user_id, r.item_id): r.score for r in ease.collect()}
    for (u, i), r in got.items():
        own = liked.get(u, [])
        shares = [sum(g in genres.get(x, ()) for x in own) / len(own) for g in genres.get(i, ())] if own else []
        assert math.isclose(r.genre_overlap, sum(shares), abs_tol=1e-9) and math.isclose(r.genre_max, max(shares, default=0), abs_tol=1e-9)
        for name, history in (("content_sim_all", own), ("content_sim_recent", own[-10:])):
            parts = [unit[x] for x in history if x in unit]
            value = getattr(r, name)
            assert (value is None) == (i not in unit or not parts)
            if value is not None:
                p = sum(parts)
                assert math.isclose(value, float(unit[i] @ p / np.linalg.norm(p)), abs_tol=1e-9)
        assert r.has_content == (i in unit) and r.ease_score == scores.get((u, i))
    for u in {k[0] for k in got}:
        own = sorted((r for k, r in got.items() if k[0] == u), key=lambda r: (r.ease_score is None, -(r.ease_score or 0), r.retriever_rank))
        assert [r.ease_rank for r in own] == list(range(len(own)))
    assert rk.feature_gap(cands, cands, ["retriever_score"]).first().max_gap == 0.0


def test_labels_and_adapter(spark, cands):
    some = cands.where("retriever_rank in (1, 4) and user_id in (1, 2)").select("user_id", "item_id")
    rows = rk.labelled(cands, some)
    assert {r.user_id for r in rows.collect()} == {1, 2} and rows.where("label = 1").count() == some.count()
    with pytest.raises(ValueError):
        rk.require_labelled(rk.labelled(cands, some.limit(0)))
    # A ranker that keeps the order gives the retriever's order.
    base = cands.select("user_id", "item_id", F.col("retriever_score").alias("score"))
    same = rk.adapt_scores(cands.where("retriever_rank < 5"), cands.select("user_id", "item_id", (-F.col("retriever_rank")).cast("double").alias("score")), base)
    order = {(r.user_id, r["rank"] - 1): r.item_id for r in ev.top_k(same, 10).collect()}
    assert order == {(r.user_id, r.retriever_rank): r.item_id for r in cands.collect()}


def test_histories_never_see_the_future(spark, context):
    seq = sq.sequences(context.train)
    rows = {(r.user_id, r.pos): r for r in seq.collect()}
    for r in sq.training_pairs(seq, 3).collect():
        assert r.history == [rows[r.user_id, p].item_id for p in range(max(0, r.pos - 3), r.pos)]
    strict = sq.strict_pairs(seq, 3).collect()
    for r in strict:
        end = sum(x.ts < rows[r.user_id, r.pos].ts for k, x in rows.items() if k[0] == r.user_id)
        assert end > 0 and r.history == [rows[r.user_id, p].item_id for p in range(max(0, end - 3), end)]
    arrays = {r.user_id: r["items"] for r in sq.sequence_arrays(context.train).collect()}
    assert arrays.keys() == {r.user_id for r in context.train.select("user_id").distinct().collect()}


def test_two_tower_gradients_and_round_trip(spark, context, tmp_path):
    model = TwoTower(dim=4, hidden=3, epochs=2, batch=8, history=3)
    pairs = sq.training_pairs(sq.sequences(context.train), 3).cache()
    model.fit(pairs, seed=1)
    n = len(model.items)
    rng = np.random.default_rng(2)
    bags, targets, log_q = rng.integers(0, n + 1, (6, 3)), np.array([1, 3, 1, 5, 7, 3]), rng.normal(size=n)
    bags[:, 0] = 2
    _, grads = model.loss(model.weights, bags, targets, log_q)
    for name, w in model.weights.items():
        for spot in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            if name == "e" and spot[0] == n:
                continue
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in model.weights.items()}
                moved[name][spot] += step
                ends.append(model.loss(moved, bags, targets, log_q)[0])
            assert math.isclose((ends[0] - ends[1]) / 2e-6, grads[name][spot], rel_tol=1e-3, abs_tol=1e-6)
    model.save(str(tmp_path / "m.npz"))
    again = TwoTower.load(str(tmp_path / "m.npz"), n_pairs=pairs.count())
    assert np.allclose(again.item_vectors(), model.item_vectors())
    with pytest.raises(ValueError):
        TwoTower.load(str(tmp_path / "m.npz"), n_pairs=1)
    users, seen = context.train.select("user_id").distinct(), context.train.select("user_id", "item_id")
    top = model.top_k(context.train, users, seen, 3)
    assert top.count() > 0 and top.join(seen, ["user_id", "item_id"]).count() == 0


def test_boosting_learns_an_order(spark):
    rows = [(u, i, int((i * 7 + u) % 10 < 2), float((i * 7 + u) % 10), None if i == 3 else 1.0) for u in range(12) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, x double, y double").cache()
    model = LambdaMart(["x", "y"], rounds=4, rate=0.5, depth=3).fit(df)
    before, after = LambdaMart._ndcg(df.withColumn("score", F.lit(0.0))), LambdaMart._ndcg(model.transform(df))
    assert after > 0.99 > before


def test_feature_tables(context):
    genres = fe.user_genres(context.train, context.items)
    assert genres.where("share <= 0 or share > 1 or genre like '%no genres%'").count() == 0
    vectors = fe.content_vectors(context.train.sparkSession.createDataFrame([(1, 3, 0.3), (1, 1, 0.1), (1, 2, 0.2), (2, 2, 0.9), (2, 1, 0.8), (2, 3, 0.7)], "item_id long, tag_id long, relevance double"))
    assert {r.item_id: r.vector for r in vectors.collect()} == {1: [0.1, 0.2, 0.3], 2: [0.8, 0.9, 0.7]}


def loss_by_hand(model, w, bags, targets, log_q, extra, pool):
    """The mean loss, one row and one logit after the other."""
    unit = lambda x: x / np.linalg.norm(x)
    total = 0.0
    for r, target in enumerate(targets):
        own = [w["e"][b] for b in bags[r] if b != len(w["e"]) - 1]
        mean = np.mean(own, axis=0)
        u = unit(mean + np.maximum(mean @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"])
        logits = [u @ unit(w["e"][t]) / model.temperature - log_q[t] for c, t in enumerate(targets) if c == r or t != target]
        logits += [u @ unit(w["e"][t]) / model.temperature + np.log(pool) for t in extra if t != target]
        mine = u @ unit(w["e"][target]) / model.temperature - log_q[target]
        total += np.log(np.sum(np.exp(logits))) - mine
    return total / len(targets)


def test_two_tower_loss_with_uniform_negatives():
    model = TwoTower(dim=4, hidden=3, history=3)
    rng = np.random.default_rng(3)
    n = 10
    w = {"e": rng.normal(size=(n + 1, 4)), "w1": rng.normal(size=(4, 3)), "b1": rng.normal(size=3), "w2": rng.normal(size=(3, 4)), "b2": rng.normal(size=4)}
    bags, targets, log_q, extra = rng.integers(0, n, (6, 3)), np.array([1, 3, 1, 5, 7, 3]), rng.normal(size=n), np.array([2, 3, 9])
    bags[0, 2] = n
    for more in (extra, extra[:0]):
        value, grads = model.loss(w, bags, targets, log_q, more, 8)
        assert math.isclose(value, loss_by_hand(model, w, bags, targets, log_q, more, 8))
        for name, x in w.items():
            for spot in list(np.ndindex(x.shape))[:: max(1, x.size // 9)]:
                if name == "e" and spot[0] == n:
                    continue
                ends = []
                for step in (1e-6, -1e-6):
                    moved = {k: v.copy() for k, v in w.items()}
                    moved[name][spot] += step
                    ends.append(loss_by_hand(model, moved, bags, targets, log_q, more, 8))
                assert math.isclose((ends[0] - ends[1]) / 2e-6, grads[name][spot], rel_tol=1e-3, abs_tol=1e-6)


def test_each_epoch_draws_anew_and_parts_hold_all_pairs(spark, context, monkeypatch, tmp_path):
    from tidemark.plans import retriever

    pairs = sq.training_pairs(sq.sequences(context.train), 3).cache()
    drawn = []
    monkeypatch.setattr(TwoTower, "log_q", lambda self, d, own=TwoTower.log_q: drawn.append({(r.user_id, r.pos) for r in d.collect()}) or own(self, d))
    model = TwoTower(dim=4, hidden=3, epochs=3, batch=8, history=3, cap=2, uniform=3).fit(pairs, seed=1)
    assert len(drawn) == 3 and drawn[0] != drawn[1] and all(sum(u == 1 for u, _ in d) <= 2 for d in drawn)
    monkeypatch.setattr(retriever, "PART_PAIRS", 7)
    parts = list(model.batches(pairs, 5, 1))
    whole = next(model.batches(pairs, 1, 1))
    assert len(parts) > 1 and sorted(t for _, ts in parts for t in ts) == sorted(whole[1])
    a, b = TwoTower(dim=4, hidden=3, epochs=2, batch=8, history=3).fit(pairs, seed=1), TwoTower(dim=4, hidden=3, epochs=2, batch=8, history=3).fit(pairs.repartition(3), seed=1)
    assert np.allclose(a.item_vectors(), b.item_vectors())
    a.save(str(tmp_path / "m.npz"))
    TwoTower.load(str(tmp_path / "m.npz"), pairs=pairs)
    with pytest.raises(ValueError):
        TwoTower.load(str(tmp_path / "m.npz"), pairs=pairs.withColumn("target", F.col("target") + F.when(F.col("pos") == 1, 1).otherwise(0)))


def test_trees_draw_their_features():
    model = LambdaMart(["a", "b", "c", "d", "e"], seed=3)
    drawn = [tuple(model._drawn(n)) for n in range(20)]
    assert all(len(d) == 8 and d[4:] == tuple(i + 5 for i in d[:4]) for d in drawn) and len(set(drawn)) > 1
    assert drawn == [tuple(model._drawn(n)) for n in range(20)] and LambdaMart(["a"], fraction=0.1)._drawn(0) == [0, 1]


@pytest.mark.parametrize("dim,leaf", [(2, 7), (5, 16), (5, 1000)])
def test_leaves_hold_the_best_of_all_items(monkeypatch, dim, leaf):
    """What leaves find, with one block of items at a time, is what one matrix of users and items holds."""
    from tidemark.plans import retriever as re

    monkeypatch.setattr(re, "LEAF", leaf)
    rng = np.random.default_rng(dim + leaf)
    v = rng.normal(size=(300, dim))
    v[::50] = 0
    v[7:300:11] = v[7]  # ties, which go by item
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    u = rng.normal(size=(40, dim))
    u[3] = 0
    u[4] = v[7]
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    ids = np.arange(300) * 3
    hide = [rng.choice(300, n, replace=False) for n in [0, 295, 300, *rng.integers(0, 40, 37)]]
    leaves = re.Leaves.of(v)
    got = leaves.best(u, v[leaves.order], ids[leaves.order], [leaves.place[h] for h in hide], 6)
    for r in range(40):
        s = u[r] @ v.T
        s[hide[r]] = -np.inf
        want = sorted((i for i in range(300) if s[i] > -np.inf), key=lambda i: (-round(s[i], 12), ids[i]))[:6]
        own = got[0] == r
        assert got[3][own].tolist() == list(range(1, len(want) + 1)) and np.allclose(got[2][own], s[want], atol=1e-12)
        assert len(set(got[1][own])) == len(want) and np.allclose(s[got[1][own] // 3], s[want], atol=1e-12)


def test_steps_in_place_and_one_draw(spark, context, monkeypatch):
    """Adam in place and summed rows are what they were by formula; the shares of one draw are counted once."""
    from tidemark.plans import retriever as re

    rng = np.random.default_rng(3)
    w, m, v = (rng.normal(size=(9, 4)) ** 2 for _ in range(3))
    g = rng.normal(size=(9, 4))
    m1, v1 = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    want = w - 0.01 * (m1 / (1 - 0.9**5)) / (np.sqrt(v1 / (1 - 0.999**5)) + 1e-8)
    re.adam(w, g.copy(), m, v, 0.01, 5)
    assert np.allclose(w, want) and np.allclose(m, m1) and np.allclose(v, v1)
    at, rows = rng.integers(0, 9, 50), rng.normal(size=(50, 4))
    a, b = np.zeros((9, 4)), np.zeros((9, 4))
    np.add.at(a, at, rows)
    re.add_rows(b, at, rows)
    assert np.allclose(a, b)
    pairs = sq.training_pairs(sq.sequences(context.train), 3).cache()
    asked = []
    monkeypatch.setattr(TwoTower, "log_q", lambda self, d, own=TwoTower.log_q: asked.append(1) or own(self, d))
    TwoTower(dim=4, hidden=3, epochs=3, batch=8, history=3).fit(pairs, seed=1)
    assert len(asked) == 1


def test_sparse_steps_equal_dense_ones():
    """A gradient of some rows is never made whole, and leaves the same weights and moments, those at rest included."""
    from tidemark.plans import retriever as re

    rng = np.random.default_rng(4)
    n = 2 * re.CHUNK + 7
    one = [rng.normal(size=(n, 3)), np.zeros((n, 3)), np.zeros((n, 3))]
    two = [x.copy() for x in one]
    for step in (1, 2, 3):
        places, rows = re.summed(rng.integers(0, n, 50), rng.normal(size=(50, 3)))
        g = np.zeros((n, 3))
        g[places] = rows
        re.adam(one[0], g, one[1], one[2], 0.01, step)
        re.adam_rows(two[0], places, rows, two[1], two[2], 0.01, step)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
