import json

import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tidemark import sources as so
from tidemark.operators import splits as sp


def test_csv_with_quotes_and_commas(spark, tmp_path):
    rows = fixtures.items()
    text = "item_id,title,genres\n" + "".join('{},"{}",{}\n'.format(i, t.replace('"', '""'), g) for i, t, g in rows)
    (tmp_path / "items.csv").write_text(text)
    assert sorted(tuple(r) for r in so.read_csv(spark, str(tmp_path / "items.csv"), so.ITEMS).collect()) == rows


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("user_id,item_id,rating,ts\n1,2,x,4\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        so.read_csv(spark, str(tmp_path / "bad.csv"), so.RATINGS).collect()


def test_load_interactions(spark, tmp_path):
    sp.build_splits(spark.createDataFrame(fixtures.log(), fixtures.COLUMNS)).write.parquet(f"{tmp_path}/splits")
    fine = so.load_interactions(spark, f"{tmp_path}/splits/*.parquet", fine=True)
    assert {r.split for r in fine.select("split").distinct().collect()} == {"train_core", "train_tail", "val", "test"}
    with pytest.raises(ValueError):
        so.load_interactions(spark, f"{tmp_path}/splits", "global", fine=True)
    assert so.require_rows(fine, 200).count() == 200
    with pytest.raises(ValueError):
        so.require_rows(fine, 201)


def test_stats_are_sorted_and_repeatable(tmp_path):
    rows = [("user", "b", 2), ("global", "a", 1 / 3), ("user", "a", None)]
    so.write_stats(rows, str(tmp_path / "1.csv"))
    so.write_stats(rows[::-1], str(tmp_path / "2.csv"))
    assert (tmp_path / "1.csv").read_bytes() == (tmp_path / "2.csv").read_bytes() == b"scheme,stat,value\nglobal,a,0.333333\nuser,a,\nuser,b,2\n"


def test_replace_and_append(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "model string, v long")
    new = spark.createDataFrame([("b", 9)], "model string, v long")
    assert sorted(map(tuple, so.replace_rows(old, new, "model", "b").collect()), key=str) == [("a", 1), ("b", 9), (None, 3)]
    for _ in range(2):
        so.append_results(new, f"{tmp_path}/results")
    assert so.read_parquet(spark, f"{tmp_path}/results", ["v"]).count() == 2


def test_atomic_json_leaves_nothing_behind(tmp_path):
    so.write_json_atomic({"b": 1}, str(tmp_path / "x.json"))
    with pytest.raises(TypeError):
        so.write_json_atomic({"b": object()}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": 1} and len(list(tmp_path.iterdir())) == 1


def test_checked_file(tmp_path):
    import hashlib

    path = tmp_path / "f.csv"
    path.write_bytes(b"a\nb\n")
    own = hashlib.sha256(b"a\nb\n").hexdigest()
    assert so.checked_file(str(path), own, hashlib.md5(b"a\nb\n").hexdigest(), 2) == str(path)
    for bad in ({"sha256": "0"}, {"md5": "0"}, {"lines": 3}):
        with pytest.raises(ValueError):
            so.checked_file(str(path), **bad)


def test_rows_of_a_key_are_replaced_in_place(spark, tmp_path):
    from tidemark.sources import replace_key

    path = f"file://{tmp_path}/results"
    frame = lambda *rows: spark.createDataFrame(list(rows), "model string, value double")
    replace_key(spark, path, frame(("a", 1.0), ("b", 2.0)), "model", "a")
    replace_key(spark, path, spark.read.parquet(path).where("model = 'a'").withColumn("value", F.lit(9.0)), "model", "a")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 9.0), ("b", 2.0)}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["results"]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from tidemark.sources import shared_path

    assert shared_path(spark, "x").startswith("file://")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="share"):
        shared_path(Session(), "x")
