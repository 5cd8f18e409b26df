import duckdb
import pytest

from tidemark.operators import models as mo
from tidemark.operators import ranking as rk
from tidemark.plans import ranker, retriever
from tidemark.plans.queries import ORACLES, QUERIES


def test_whole_queries_take_the_operators_defaults():
    for name in [n for n in QUERIES if n.endswith("_whole")]:
        assert ORACLES[name] != ORACLES[name.removesuffix("_whole")]
    assert f"rank <= {rk.CANDIDATES})" in ORACLES["candidates_whole"]
    assert "range(1, 1001)" in ORACLES["poisson_bootstrap_ci_whole"]


def test_models_train_with_their_defaults(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(retriever.TwoTower, "fit", lambda self, *a, **k: seen.update(tower=self) or self)
    monkeypatch.setattr(retriever.TwoTower, "top_k", lambda self, train, *a: train.withColumn("rank", train["item_id"]))
    QUERIES["two_tower_topk"](spark, sf_dir)
    assert seen["tower"] == retriever.TwoTower()
    monkeypatch.setattr(ranker.LambdaMart, "fit", lambda self, rows: seen.update(mart=self) or self)
    monkeypatch.setattr(ranker.LambdaMart, "transform", lambda self, rows: rows.withColumn("score", rows["item_mean"]))
    taken = mo.popular_top_k
    monkeypatch.setattr(mo, "popular_top_k", lambda *a: seen.update(k=a[-1]) or taken(*a))
    QUERIES["lambdamart_scores"](spark, sf_dir)
    assert seen["mart"].rounds == ranker.LambdaMart([]).rounds and seen["k"] == rk.CANDIDATES


@pytest.mark.parametrize("name", ["candidates_whole", "labelled_rows_whole", "benchmark_input_whole"])
def test_whole_queries_equal_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(db.sql(ORACLES[name]).fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).collect()), key=str)
    assert len(got) == len(want) > 0 and got == want
