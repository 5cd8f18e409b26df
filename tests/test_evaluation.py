import math

import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tidemark.operators import evaluation as ev
from tidemark.operators import splits as sp
from tidemark.operators.splits import build_splits

PAIRS = "user_id long, item_id long"


def frame(spark, rows, columns=PAIRS):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def toy(spark):
    """Six items, two users, three places: worked out by hand."""
    data = ev.EvalData(frame(spark, [(1,), (2,)], "user_id long"), frame(spark, [(1, 10)]), frame(spark, [(1, 30), (1, 50), (2, 10)]), frame(spark, [(i,) for i in range(10, 70, 10)], "item_id long"), frame(spark, [(1, 10)]))
    drawn = frame(spark, [(1, 40), (1, 60), (2, 20), (2, 60)])
    scores = [(1, 10 * (i + 1), s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5, 0.4])] + [(2, 10 * (i + 1), s) for i, s in enumerate([0.5] * 5 + [0.9])]
    return data, drawn, frame(spark, scores, f"{PAIRS}, score double")


def test_worked_example(toy):
    data, drawn, scores = toy
    masked = ev.mask_seen(scores, data.seen)
    top = ev.top_k(masked, 3)
    got = {u: [r.item_id for r in sorted(top.where(F.col("user_id") == u).collect(), key=lambda r: r["rank"])] for u in (1, 2)}
    assert got == {1: [20, 30, 40], 2: [60, 10, 20]}
    users = {r.user_id: r for r in ev.user_metrics(top, data, 3).collect()}
    assert users[1].recall == 0.5 and users[2].recall == 1.0
    assert round(users[1].ndcg, 6) == 0.386853 and round(users[2].ndcg, 6) == 0.63093
    assert {r.user_id: r.auc for r in ev.user_auc(masked, data, drawn).collect()} == {1: 0.75, 2: 0.25}
    row = ev.evaluate(scores, data, drawn, 3).first()
    assert (row.n_users, row.recall, row.ndcg, row.auc) == (2, 0.75, 0.508891, 0.5)
    assert ev.coverage(top, data).first().coverage == round(5 / 6, 6)


def test_no_scores_keep_every_user(toy, spark):
    data, drawn, scores = toy
    row = ev.evaluate(scores.limit(0), data, drawn, 3).first()
    assert (row.n_users, row.recall, row.ndcg, row.auc) == (2, 0.0, 0.0, 0.5)
    row = ev.evaluate(scores.withColumn("score", F.lit(float("-inf"))), data, drawn, 3).first()
    assert (row.n_users, row.recall, row.auc) == (2, 0.0, 0.5)


def test_recall_counts_at_most_k(spark):
    data = ev.EvalData(frame(spark, [(1,), (2,)], "user_id long"), frame(spark, []), frame(spark, [(u, i) for u in (1, 2) for i in range(5)]), frame(spark, [(i,) for i in range(9)], "item_id long"), frame(spark, []))
    top = frame(spark, [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 8, 2), (2, 1, 3)], f"{PAIRS}, rank long")
    assert {r.user_id: round(r.recall, 6) for r in ev.user_metrics(top, data, 3).collect()} == {1: 1.0, 2: 0.666667}


def test_oracle_is_perfect_and_bad_scores_are_refused(toy):
    data, drawn, scores = toy
    row = ev.evaluate(ev.oracle_scores(data), data, drawn, 3).first()
    assert (row.recall, row.ndcg, row.auc) == (1.0, 1.0, 1.0)
    for bad in (scores.withColumn("score", F.lit(float("nan"))), scores.withColumn("score", F.lit(float("inf"))), scores.union(scores)):
        with pytest.raises(ValueError):
            ev.check_scores(bad)
    assert ev.check_scores(scores) is scores


def test_top_k_ties_equal_a_stable_sort(spark):
    import random

    rng = random.Random(5)
    rows = [(u, i, rng.choice([0.0, 1.0, 2.0, float("-inf")])) for u in range(6) for i in range(60)]
    got = {(r.user_id, r["rank"]): r.item_id for r in ev.top_k(frame(spark, rows, f"{PAIRS}, score double"), 10).collect()}
    for u in range(6):
        want = sorted(((-s, i) for x, i, s in rows if x == u and s > float("-inf")))[:10]
        assert [i for _, i in want] == [got[u, r + 1] for r in range(len(want))]


def test_who_saw_everything_is_skipped(toy, spark):
    data, _, _ = toy
    all_seen = ev.EvalData(data.population, frame(spark, [(1, 10), (1, 20)]), data.relevant, data.train_items, data.ever_rated)
    assert [r.user_id for r in ev.skipped_users(all_seen, frame(spark, [(10,), (20,)], "item_id long")).collect()] == [1]


@pytest.mark.parametrize("scheme", sp.SCHEMES)
@pytest.mark.parametrize("target", ["val", "test"])
def test_protocol(spark, scheme, target):
    rows = build_splits(spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)).toPandas()
    label = rows[f"split_{scheme}"]
    pos, earlier = rows["rating"] >= 4, label.isin(["train"] if target == "val" else ["train", "val"])
    users = set(rows.user_id[pos & (label == "train")]) & set(rows.user_id[pos & (label == target)])
    data = ev.eval_data(spark.createDataFrame(rows), scheme, target)
    pairs = lambda m: {(a, b) for a, b in zip(rows.user_id[m], rows.item_id[m], strict=True) if a in users}
    got = lambda d: {tuple(r) for r in d.collect()}
    assert got(data.population) == {(u,) for u in users}
    assert got(data.seen) == pairs(earlier) and got(data.relevant) == pairs(pos & (label == target)) and got(data.ever_rated) == pairs(label.notna())
    assert got(data.train_items) == {(i,) for i in rows.item_id[earlier]}
    if users:
        drawn = ev.negatives(data, 3).collect()
        assert len(set(map(tuple, drawn))) == 3 * len(users)
        assert not set(map(tuple, drawn)) & got(data.ever_rated) and {(r.item_id,) for r in drawn} <= got(data.train_items)
        with pytest.raises(Exception, match="fewer than 40"):
            ev.negatives(data, 40).collect()


def test_gain_of_the_ideal(spark):
    from tidemark.functions import ideal_gain

    row = spark.range(1).select(ideal_gain(F.lit(3)).alias("x"), ideal_gain(F.lit(0)).alias("y")).first()
    assert row.y == 0 and math.isclose(row.x, 1 + 1 / math.log2(3) + 0.5)


def test_evaluate_applies_its_own_rules(toy, spark):
    data, drawn, scores = toy
    for bad in (scores.withColumn("score", F.lit(float("nan"))), scores.withColumn("score", F.lit(float("inf"))), scores.withColumn("score", F.lit(None).cast("double")), scores.union(scores)):
        with pytest.raises(Exception, match="one for each pair"):
            ev.evaluate(bad, data, drawn, 3).collect()
    catalog = frame(spark, [(i,) for i in range(10, 70, 10)], "item_id long")
    full = ev.EvalData(data.population, frame(spark, [(1, i) for i in range(10, 70, 10)]), data.relevant, data.train_items, data.ever_rated)
    row = ev.evaluate(scores, full, drawn, 3, catalog).first()
    assert (row.n_users, row.recall, row.ndcg) == (1, 1.0, 0.63093)
    assert ev.evaluate(scores, data, drawn, 3, catalog).first().n_users == 2


def test_summary_counts_who_is_left_out(toy, spark):
    data, drawn, scores = toy
    catalog = data.train_items
    log = [(1, 10, 5.0, "train"), (1, 30, 5.0, "val"), (1, 50, 4.0, "val"), (2, 20, 4.0, "train"), (2, 10, 4.0, "val"), (3, 10, 2.0, "train"), (3, 20, 5.0, "val"), (4, 10, 5.0, "train"), (4, 20, 1.0, "val"), (5, 10, 1.0, "train")]
    splits = spark.createDataFrame(log, f"{PAIRS}, rating double, split_user string")
    masked = ev.mask_seen(scores, data.seen)
    row = ev.summary(ev.top_k(masked, 3), data, splits, catalog, ev.user_auc(masked, data, drawn), k=3).first()
    assert (row.n_users, row.recall, row.ndcg, row.auc, row.n_covered, row.n_train_items, row.skipped_all_seen) == (2, 0.75, 0.508891, 0.5, 5, 6, 0)
    assert (row.excluded_no_train_positive, row.excluded_no_target_positive) == (2, 1)
