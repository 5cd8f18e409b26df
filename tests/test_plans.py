import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tidemark.operators import models as mo
from tidemark.operators import statistics as st
from tidemark.plans import queries
from tidemark.plans.bench import feature_pipeline, whole_users
from tidemark.plans.publishing import Registry, Rejected, retrain
from tidemark.plans.reports import check_claims, drifted, render
from tidemark.plans.serving import NotReady, OutOfRange, Recommender, export_bundle, profiles, recommend_all, with_fallback
from tidemark.plans.tuning import PLANS, Tuner, canonical, score_once


def users(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "user_id long, ndcg double")


def test_bootstrap(spark):
    a = users(spark, [0.1 * (i % 7) for i in range(200)])
    same = st.bootstrap(st.paired(a, a, "ndcg"), n=100).first()
    assert (same["mean"], same.lo, same.hi) == (0.0, 0.0, 0.0)
    shifted = st.bootstrap(st.paired(a.withColumn("ndcg", F.col("ndcg") + 0.1), a, "ndcg"), n=100).first()
    assert (shifted["mean"], shifted.lo, shifted.hi) == (0.1, 0.1, 0.1)
    own = st.bootstrap(a.withColumnRenamed("ndcg", "diff"), n=200).first()
    assert own.lo < own["mean"] < own.hi
    with pytest.raises(ValueError):
        st.paired(a, a.where("user_id > 0"), "ndcg")
    ratio = st.ratio_interval(a.withColumn("ndcg", F.col("ndcg") * 2), a, "ndcg", n=100).first()
    assert ratio.ratio == 2.0 and ratio.lo < 2.0 < ratio.hi


def test_poisson_weights_have_mean_and_variance_one(spark):
    row = spark.range(100_000).select(st.poisson_weight((F.col("id") + 0.5) / 100_000).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(row.m - 1) < 1e-3 and abs(row.v - 1) < 1e-2


def test_outputs_are_compared_with_multiplicity(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1), (2, None)], "x long, y double")
    b = spark.createDataFrame([(1, 0.1 + 1e-12), (2, None), (3, 1.0)], "x long, y double")
    assert tuple(st.same_output(a, b).first()) == (1, 1)
    assert tuple(st.same_output(a, a).first()) == (0, 0)


def test_summaries(spark):
    runs = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.3), ("a", 3, 0.2), ("b", 1, 1.0)], "model string, seed int, v double")
    assert {tuple(r) for r in st.seed_summary(runs, "v").collect()} == {("a", 0.2, 0.1, 0.3, 3), ("b", 1.0, 1.0, 1.0, 1)}
    t = spark.createDataFrame([("x", float(i)) for i in range(101)], "stage string, ms double")
    assert tuple(st.latency_percentiles(t).first()) == ("x", 50.0, 90.0, 99.0, 100.0)
    figures = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "model string, value double")
    assert [r.held for r in st.verdicts(figures, [("1", "a", "b", 0.05), ("2", "a", "b", 0.1), ("3", "b", "c", 0.0)]).orderBy("claim").collect()] == [True, False, False]
    wide = st.pivoted(runs, "model", "seed", [1, 2], "v")
    assert {tuple(r) for r in wide.collect()} == {("a", 0.1, 0.3), ("b", 1.0, None)}
    tops = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "user_id long, item_id long, rank long")
    other = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "user_id long, item_id long, rank long")
    assert tuple(st.overlap(tops, other, 2).first()) == (1, 0.5, False)


def test_gate_in_spark(spark):
    low, high = users(spark, [0.1, 0.1]), users(spark, [0.1, 0.2])
    assert st.publish_gate(high, low).first().publish and not st.publish_gate(low, low).first().publish
    assert st.publish_gate(low, None).first().publish


def test_registry(tmp_path):
    registry = Registry(str(tmp_path))
    with pytest.raises(Rejected):
        registry.publish("none")
    seen = []
    assert retrain(registry, "a/1", seen.append, lambda own: 0.5) == "published"
    assert retrain(registry, "b", seen.append, lambda own: 0.503) == "rejected"
    assert registry.live == {"run": "a_1", "value": 0.5} and seen[0].endswith("a_1")
    with pytest.raises(Rejected):
        registry.publish("b")

    def smoke(own):
        raise RuntimeError("broken bundle")

    with pytest.raises(RuntimeError):
        retrain(registry, "c", seen.append, lambda own: 0.9, smoke)
    assert registry.live["run"] == "a_1"
    assert retrain(registry, "d", seen.append, lambda own: 0.9) == "published"
    assert (tmp_path / "live").resolve().name == "d" and len((tmp_path / "decisions.csv").read_text().splitlines()) == 5


def test_tuner(tmp_path):
    calls = []

    def run(config):
        calls.append(config)
        return {"ndcg": -((config["x"] - 16) ** 2) - config.get("y", 0)}

    log = str(tmp_path / "trials.jsonl")
    tuner = Tuner(run, log=log)
    assert tuner.line({"y": 0}, "x", (1.0, 2.0, 4.0), grow=2.0, extend=5) == {"y": 0, "x": 16.0}
    n = len(calls)
    assert Tuner(run, log=log).line({"y": 0.0}, "x", (1, 2, 4)) and len(calls) == n
    assert canonical({"b": 1.0, "a": 2}) == canonical({"a": 2, "b": 1})
    assert tuner.coordinates({"x": 4, "y": 1}, [("y", (0, 1)), ("x", (8, 16))])["x"] == 16 and tuner.best()["x"] == 16
    assert tuner.line({"y": 3}, "x", (20.0, 30.0), grow=2.0, extend=3, floor=15.0)["x"] == 20.0
    assert set(PLANS) == {"knn", "ease", "als", "two_tower", "ranker"}


def test_a_sealed_score_is_written_once(tmp_path):
    path = str(tmp_path / "sealed.json")
    with pytest.raises(ZeroDivisionError):
        score_once(path, lambda: 1 / 0, {})
    assert score_once(path, lambda: {"ndcg": 1.0}, {})["metrics"] == {"ndcg": 1.0}
    with pytest.raises(FileExistsError):
        score_once(path, lambda: {"ndcg": 2.0}, {})


def test_reports(tmp_path):
    assert render("a {{ x }} b {{y}}", {"x": 1, "y": "z"}) == "a 1 b z"
    for values in ({"x": 1}, {"x": 1, "y": 2, "z": 3}):
        with pytest.raises(KeyError):
            render("{{x}} {{y}}", values)
    (tmp_path / "r.md").write_text("n: 1")
    assert not drifted(str(tmp_path / "r.md"), "n: {{n}}", {"n": 1}) and drifted(str(tmp_path / "r.md"), "n: {{n}}", {"n": 2})
    check_claims({"fine": True})
    with pytest.raises(AssertionError, match="wrong"):
        check_claims({"fine": True, "wrong": False})


def test_serving_equals_batch(spark, tmp_path):
    train = spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    scores = mo.popularity(mo.likes(train), items)
    everyone = train.select("user_id").distinct()
    ranked = recommend_all(everyone, train, scores, 10)
    table = with_fallback(everyone, ranked, train, scores, 10).cache()
    folder = str(tmp_path / "bundle")
    with pytest.raises(NotReady):
        Recommender(spark, folder).recommend(1)
    assert Recommender(spark, None).health() == {"status": "no bundle"}
    export_bundle(folder, {"recommendations": table, "profiles": profiles(train), "popular": mo.popular_list(scores, 100)}, {"seed": 42})
    service = Recommender(spark, folder)
    assert service.health() == {"status": "ok", "about": {"seed": 42}}
    for u in (1, 7):
        want = [r.item_id for r in sorted(table.where(F.col("user_id") == u).collect(), key=lambda r: r["rank"])]
        assert service.recommend(u, 4)["items"] == want[:4]
    unknown = service.recommend(12345, 3)
    assert unknown["strategy"] == "popular" and len(unknown["items"]) == 3
    rows = sorted((r for r in fixtures.log() if r[0] == 1 and r[2] >= 4), key=lambda r: (-r[3], -r[1]))
    assert service.profile(1, 5)["items"] == [r[1] for r in rows[:5]] and not service.profile(12345)["known"]
    assert service.profile(service.sample_user())["n_positives"] > 0
    for bad in (0, 101):
        with pytest.raises(OutOfRange):
            service.recommend(1, bad)


def test_http(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tidemark.plans.http import answer, server

    empty = Recommender(spark, None)
    assert answer(empty, "/health") == (200, {"status": "no bundle"}) and answer(empty, "/recommend/1")[0] == 503
    table = spark.createDataFrame([(1, 5, 1.0, 1, "ranked"), (1, 6, 0.5, 2, "ranked")], "user_id long, item_id long, score double, rank long, strategy string")
    profile = spark.createDataFrame([(1, 3, 2, [9, 8])], "user_id long, n_ratings long, n_positives long, items array<long>")
    popular = spark.createDataFrame([(7, 2.0, 1)], "item_id long, score double, place long")
    export_bundle(str(tmp_path / "b"), {"recommendations": table, "profiles": profile, "popular": popular}, {})
    own = Recommender(spark, str(tmp_path / "b"))
    assert [answer(own, t)[0] for t in ("/", "/recommend/1?k=0", "/recommend/1?k=101", "/recommend/1?k=x", "/users/1/profile?n=51", "/nothing")] == [200, 422, 422, 422, 422, 404]
    assert answer(own, "/users/random") == (200, {"user_id": 1}) and answer(own, "/users/1/profile?n=1")[1]["items"] == [9]
    web = server(own, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/recommend/1?k=1") as reply:
        assert json.load(reply) == {"user_id": 1, "strategy": "ranked", "items": [5]}
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/recommend/1?k=500")
    web.shutdown()


def test_ablation(spark):
    base = users(spark, [0.1, 0.2, 0.3])
    rows = {r.model: r for r in st.ablation({"full": base, "less": base.withColumn("ndcg", F.col("ndcg") - 0.1)}, "full", n=20).collect()}
    assert rows["full"].diff == 0.0 and rows["less"].diff == rows["less"].hi == -0.1 and rows["less"]["mean"] == 0.1


def test_whole_users_and_pipeline(spark, tmp_path):
    ratings = spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)
    got = whole_users(ratings, 60)
    sizes = {u: n for u, (n, _, _) in fixtures.USERS.items()}
    chosen = {r.user_id for r in got.select("user_id").distinct().collect()}
    assert got.count() == sum(sizes[u] for u in chosen) >= 60 > got.count() - max(sizes.values())
    feature_pipeline(ratings, spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/splits").count() == 200 and spark.read.parquet(f"{tmp_path}/users").count() == 9


def test_entry_and_registered_queries(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.ORACLES) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["per_user_split", "split_violations", "popular_metrics", "knn_topk", "pit_features", "strict_histories"])
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = con.execute(queries.ORACLES[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(map(str, r)) for r in rel.fetchall()))
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want and want


def test_requests_read_one_bucket_once(spark, tmp_path):
    train = spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    scores = mo.popularity(mo.likes(train), items)
    seen = train.select("user_id", "item_id").distinct()
    folder = str(tmp_path / "bundle")
    export_bundle(folder, {"profiles": profiles(train), "popular": mo.popular_list(scores, 100), "seen": seen}, {"n": 1}, users_a_bucket=2)
    service = Recommender(spark, folder)
    assert service.warm_up() == 1 + 2 * 5  # nine users in five buckets
    want = {r.user_id: [] for r in seen.collect()}
    for r in sorted(recommend_all(seen.select("user_id").distinct(), train, scores, 6).collect(), key=lambda r: r["rank"]):
        want[r.user_id].append(r.item_id)
    service.spark = None
    service._bundle = lambda: service._manifest  # no job from here on
    for user, own in want.items():
        assert service.recommend(user, 6) == {"user_id": user, "strategy": "popular", "items": own} and service.profile(user)["known"]
    again = Recommender(spark, folder, keep=2)
    assert again.recommend(1, 6)["items"] == want[1] and len(again._kept) == 2
    export_bundle(folder, {"profiles": profiles(train), "popular": mo.popular_list(scores, 1)}, {"n": 2})
    assert again.recommend(1, 6)["items"] == [mo.popular_list(scores, 1).first().item_id] and again.health()["about"] == {"n": 2}


def test_what_is_kept_is_bounded_by_its_size(spark, tmp_path, monkeypatch):
    from tidemark.plans import serving

    train = spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    scores = mo.popularity(mo.likes(train), items)
    seen = train.select("user_id", "item_id").distinct()
    monkeypatch.setattr(serving, "ROWS_A_BUCKET", 20)
    monkeypatch.setattr(serving, "KEPT_NUMBERS", 250)
    folder = str(tmp_path / "bundle")
    export_bundle(folder, {"profiles": profiles(train), "popular": mo.popular_list(scores, 100), "seen": seen}, {"n": 1})
    service = Recommender(spark, folder)
    assert service._bundle()["tables"]["seen"]["buckets"] == 10 and service._bundle()["tables"]["profiles"]["buckets"] == 1
    service.warm_up()
    want = {(r.user_id, r["rank"]): r.item_id for r in recommend_all(seen.select("user_id").distinct(), train, scores, 6).collect()}
    for user in range(1, 10):
        assert service.recommend(user, 6)["items"] == [want[user, n] for n in range(1, 7)] and service.profile(user)["known"]
        held = sum(len(x) if isinstance(x, list) else 1 for rows in service._kept.values() for own in rows.values() for r in own for x in r)
        assert len(service._kept) == 1 or held <= 250
    assert service.recommend(-1, 6)["strategy"] == "popular" and not service.profile(12345)["known"]


def test_two_stages(spark):
    from tidemark.operators import evaluation as ev
    from tidemark.operators import ranking as rk
    from tidemark.operators.splits import build_splits
    from tidemark.plans.two_stage import TwoStage

    splits = build_splits(spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)).cache()
    items = spark.createDataFrame(fixtures.items(), "item_id long, title string, genres string")
    relevance = spark.createDataFrame([(i, t, (i * 7 + t * 3) % 11 / 11 + 0.1) for i in range(1, 26) for t in range(6)], "item_id long, tag_id long, relevance double")
    chain = TwoStage(retriever={"dim": 8, "epochs": 2, "cap": 5, "uniform": 4}, ranker={"rounds": 3}, lam=5.0, min_positives=1, candidates=15).fit(splits, items, relevance)
    assert chain.model.features == rk.HEADLINE and len(rk.HEADLINE) == 15
    data = ev.eval_data(splits)
    scores = chain.scores(data.population).cache()
    per = scores.groupBy("user_id").count().collect()
    assert len(per) == data.population.count() and all(r["count"] <= 15 for r in per)
    assert scores.join(data.seen, ["user_id", "item_id"]).count() == 0
    row = ev.evaluate(scores, data, ev.negatives(data, 3), catalog=items.select("item_id")).first()
    assert row.n_users == len(per) and 0 <= row.recall <= 1
    top = chain.recommend(data.population, 5)
    assert top.groupBy("user_id").count().where("count > 5").count() == 0
