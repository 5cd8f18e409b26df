"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. The feature pipeline (splits and the
its outputs are compared with DuckDB's before any time counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from tidemark.plans import oracles
from tidemark.plans.bench import feature_pipeline
from tidemark.plans.queries import QUERIES
from tidemark.session import get_session
from tidemark.sources import views

HEADLINE = ["per_user_split", "item_features_train", "user_features_train", "user_genres_train", "split_violations", "burst_stats", "eval_negatives", "popular_metrics", "training_pairs", "pit_features", "genome_similarity"]


def same_as_duckdb(spark, sf_dir: str, out: str) -> None:
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    base = "WITH " + ",\n".join([oracles.SPLITS, oracles.train(), oracles.ITEMS])
    figures = {
        "splits": "SELECT count(*), sum(user_id * item_id % 1009), count(*) FILTER (split_user = 'train'), count(*) FILTER (train_part = 'core') FROM splits",
        "items": "SELECT count(DISTINCT item_id), count(*), count(*) FILTER (rating >= 4), sum(ts) FROM train",
        "user_genres": "SELECT count(*), sum(c) FROM (SELECT user_id, genre, count(*) AS c FROM liked JOIN item_genres USING (item_id) GROUP BY user_id, genre)",
    }
    want = {k: tuple(map(int, con.execute(f"{base} {sql}").fetchall()[0])) for k, sql in figures.items()}
    t = {n: spark.read.parquet(f"{out}/{n}") for n in ("splits", "items", "users", "user_genres")}
    for n, df in t.items():
        df.createOrReplaceTempView(f"bench_{n}")
    got = {
        "splits": "SELECT count(*), sum(user_id * item_id % 1009), count_if(split_user = 'train'), count_if(train_part = 'core') FROM bench_splits",
        "items": "SELECT count(*), sum(n_ratings), sum(n_positives), (SELECT sum(ts) FROM bench_splits WHERE split_user = 'train') FROM bench_items",
        "user_genres": "SELECT count(*), sum(round(share * n_positives)) FROM bench_user_genres JOIN bench_users USING (user_id)",
    }
    for k, sql in got.items():
        found = tuple(int(x) for x in spark.sql(sql).first())
        if found != want[k]:
            sys.exit(f"{k}: Spark has {found}, DuckDB {want[k]}")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    began = time.time()
    spark = get_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    startup = time.time() - began
    times: dict[str, float] = {"startup": round(startup, 3)}
    work = tempfile.mkdtemp(prefix="tidemark-bench-")
    try:
        # One table of ratings is read, four are written.
        views.ratings(spark, sf_dir).write.parquet(f"{work}/ratings")
        views.items(spark, sf_dir).write.parquet(f"{work}/items")
        runs = []
        for _ in range(4):
            t = time.time()
            feature_pipeline(spark.read.parquet(f"{work}/ratings"), spark.read.parquet(f"{work}/items"), f"{work}/out")
            runs.append(time.time() - t)
        same_as_duckdb(spark, sf_dir, f"{work}/out")
        times |= {"feature_pipeline_cold": round(runs[0], 3), "feature_pipeline_warm": round(median(runs[1:]), 3)}
        for name in HEADLINE:
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    total = round(sum(v for k, v in times.items() if k != "startup"), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
