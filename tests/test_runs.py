import pytest

from tests import fixtures
from tidemark.operators.splits import build_splits
from tidemark.plans import predictions as pr
from tidemark.plans.publishing import Registry
from tidemark.plans.reports import render
from tidemark.plans.runs import Run, smoke_test
from tidemark.plans.search import Bench, search


@pytest.fixture(scope="module")
def log(spark):
    splits = build_splits(spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)).cache()
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    relevance = spark.createDataFrame([(i, t, (i * 7 + t * 3) % 11 / 11 + 0.1) for i in range(1, 26) for t in range(6)], "item_id long, tag_id long, relevance double")
    return splits, items, relevance


SMALL = {"retriever": {"dim": 4, "epochs": 1}, "ranker": {"rounds": 2}, "lam": 5.0, "min_positives": 1, "candidates": 12}


def test_every_plan_reaches_its_model(log, tmp_path):
    bench = Bench(*log, users=2)
    assert bench.data.population.count() == 2
    plans = {
        "knn": ({"k": 5, "shrink": 0.0, "min_positives": 2}, [("k", (5, 10))], 1),
        "ease": ({"lam": 5.0, "min_positives": 2}, [("lam", (5.0, 50.0))], 1),
        "als": ({"rank": 4, "reg": 0.1, "alpha": 5.0}, [("alpha", (1.0, 5.0))], 1),
        "two_tower": ({"dim": 4, "temperature": 0.1, "rate": 0.01, "history": 3, "batch": 16, "hidden": 4, "epochs": 1}, [("dim", (4,))], 1),
    }
    for model, plan in plans.items():
        path = str(tmp_path / model)
        best, tuner = search(bench, model, path, plan)
        assert set(best) == set(plan[0]) and all(0 <= t["metrics"]["ndcg"] <= 1 for t in tuner.done.values())
        assert len(open(path).readlines()) == len(tuner.done)
    assert 0 <= bench.popular({})["recall"] <= 1


def test_a_run_from_training_to_the_live_bundle(spark, log, tmp_path):
    registry = Registry(str(tmp_path))
    assert Run(*log, SMALL).run(registry, "one", smoke_test) == "published"
    assert registry.live["run"] == "one"
    service = __import__("tidemark.plans.serving", fromlist=["Recommender"]).Recommender(spark, f"{tmp_path}/live/bundle")
    assert service.health()["about"]["features"] and service.recommend(1)["strategy"] == "ranked" and service.recommend(-1)["strategy"] == "popular"
    assert Run(*log, SMALL).run(registry, "again") == "rejected" and registry.live["run"] == "one"
    with pytest.raises(RuntimeError):
        smoke_test(str(tmp_path / "nothing"))


def test_predictions(spark):
    base = {"popular": (0.1, 0.1, 0.01), "ease": (0.2, 0.2, 0.2), "two_tower": (0.19, 0.19, 0.3), "two_stage": (0.195, 0.2, 0.3)}
    figures = spark.createDataFrame([(m, s, *v) for m, v in base.items() for s in (1, 2)], "model string, seed int, ndcg double, recall double, coverage double")
    users = spark.createDataFrame([(m, s, u, v[0], v[1]) for m, v in base.items() for s in (1, 2) for u in range(20)], "model string, seed int, user_id long, ndcg double, recall double")
    found = pr.of_models(figures, users, 50)
    assert [ok for _, ok, _ in found] == [True, True, True, True]
    worse = figures.replace({"two_stage": "other"}, subset=["model"])
    assert {ok for _, ok, _ in pr.of_models(worse, users, 50)} == {None}
    far = figures.withColumn("recall", figures["recall"] + 0.2 * (figures["model"] == "ease").cast("double")).withColumn("coverage", figures["coverage"] * (figures["model"] == "popular").cast("double"))
    assert [ok for _, ok, _ in pr.of_models(far, users, 50)] == [True, False, True, False]
    seconds = {(e, "1M", k): [v, v + 1, v + 9] for e, v in (("single", 1.0), ("spark", 5.0)) for k in ("cold", "warm")}
    assert pr.of_engines(seconds)[1] is True and pr.of_engines(seconds, clean=False)[1] is None and pr.of_engines(seconds | {("single", "1M", "warm"): [9.0]})[1] is False
    assert pr.of_latency(4, 20)[1] and not pr.of_latency(12, 20)[1]
    assert pr.of_schemes(0.3, 0.2, 0.1)[1] and not pr.of_schemes(0.3, 0.35, 0.1)[1] and not pr.of_schemes(0.14, 0.12, 0.1)[1]
    status = spark.createDataFrame([(1, "refuted", "earlier"), (5, "not settled", "noise")], pr.SCHEMA)
    after = pr.settle(status, [*found, pr.of_engines(seconds)])
    assert {r.id: r.verdict for r in after.collect()} == {1: "refuted", 2: "confirmed", 3: "confirmed", 4: "confirmed", 5: "confirmed"}
    values = pr.report_values(after, figures, spark.createDataFrame([(1234,)], "users int"))
    text = "\n".join(f"{{{{{k}}}}}" for k in values)
    assert "1,234" in render(text, values) and values["test.ease.coverage"] == "20.0%" and values["prediction.1"] == "refuted"
