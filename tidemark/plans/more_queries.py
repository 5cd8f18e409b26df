"""More registered queries: sources and sinks, report statistics, parts of the ranking, planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import key_hash, safe_run_id_column
from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import models as mo
from ..operators import ranking as rk
from ..operators import splits as sp
from ..operators import statistics as st
from ..operators.ease import Ease
from .. import sources as so
from ..sources import shared_path, views, written
from . import oracles as o
from .bench import feature_pipeline
from .oracles import q
from .queries import _CAND, _POP, _RND, _TEST, Data, _candidates, _popular, _runs, query

# ---- sources and sinks: written to the shared folder and read back by the library's own readers

_SCHEMES = list(sp.SCHEMES)


@query(f"WITH {o.RATINGS} SELECT user_id, item_id, rating, ts FROM ratings")
def csv_scan(spark, d):
    path = shared_path(spark, "csv-ratings")
    views.ratings(spark, d).write.option("header", True).csv(path)
    df = so.read_csv(spark, path, so.RATINGS)
    return df.select(F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"), "rating", "ts")


@query(q(o.ITEMS, select="""SELECT item_id, replace(title, ' ', '", "') AS title, genres FROM items"""))
def csv_quoted_items(spark, d):
    """Titles with commas and quotes come back as they were."""
    path = shared_path(spark, "csv-items")
    items = views.items(spark, d).withColumn("title", F.replace("title", F.lit(" "), F.lit('", "')))
    items.write.options(header="true", quote='"', escape='"').csv(path)
    return so.read_csv(spark, path, so.ITEMS).select(F.col("item_id").cast("bigint"), "title", "genres")


def _split_table(spark, d) -> str:
    path = shared_path(spark, "splits")
    so.write_parquet(Data(spark, d).splits, path)
    return path


for _s in _SCHEMES:
    query(q(o.SPLITS, select=f"SELECT user_id, item_id, rating, ts, split_{_s} AS split FROM splits"), f"projected_scan_{_s}")(lambda spark, d, s=_s: so.load_interactions(spark, _split_table(spark, d), s))


@query(q(o.SPLITS, select="SELECT user_id, item_id, rating, ts, CASE WHEN split_user = 'train' THEN 'train_' || train_part ELSE split_user END AS split FROM splits"))
def fine_scan(spark, d):
    return so.load_interactions(spark, _split_table(spark, d), fine=True)


@query(q(o.SPLITS, select="SELECT split_user, count(*) AS n, sum(item_id)::BIGINT AS items FROM splits WHERE split_user <> 'train' GROUP BY split_user"))
def glob_scan(spark, d):
    """A sink with a folder for each slice, of which a glob reads two."""
    path = shared_path(spark, "by-slice")
    so.write_parquet(Data(spark, d).splits.withColumn("slice", F.col("split_user")), path, partition_by=["slice"])
    rows = so.read_parquet(spark, f"{path}/slice=[vt][ae][ls]*", ["split_user", "item_id"])
    return rows.groupBy("split_user").agg(F.count("*").alias("n"), F.sum("item_id").alias("items"))


@query(q(o.SPLITS, o.train(), select="SELECT user_id, count(*) AS n, min(item_id) AS first_item FROM train GROUP BY user_id"))
def per_user_sink(spark, d):
    path = shared_path(spark, "per-user")
    so.write_parquet(Data(spark, d).train().groupBy("user_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item")), path)
    return so.read_parquet(spark, path, ["user_id", "n", "first_item"])


@query(q(o.SPLITS, select=" UNION ALL ".join(f"SELECT '{s}' AS scheme, 'n_' || split_{s} AS stat, count(*)::VARCHAR AS value FROM splits GROUP BY split_{s}" for s in _SCHEMES)))
def stats_csv(spark, d):
    """The file of statistics: text values, sorted, the same bytes from the same log."""
    import tempfile

    splits = Data(spark, d).splits
    rows = [(s, f"n_{r['split']}", r["n"]) for s in _SCHEMES for r in sp.split_counts(splits, s).collect()]  # three rows each
    with tempfile.TemporaryDirectory() as folder:  # a report on the driver's own disk
        so.write_stats(reversed(rows), f"{folder}/stats.csv")
        with open(f"{folder}/stats.csv", encoding="utf-8") as file:
            head, *lines = file.read().splitlines()
    if head != "scheme,stat,value" or lines != sorted(lines):
        raise AssertionError("the file isn't in order")
    return spark.createDataFrame([tuple(x.split(",")) for x in lines], "scheme string, stat string, value string")


@query(q(o.SPLITS, select="SELECT split_user AS model, count(*) AS n, 2::BIGINT AS runs FROM splits GROUP BY split_user"))
def append_results(spark, d):
    path = shared_path(spark, "results")
    rows = Data(spark, d).splits.groupBy(F.col("split_user").alias("model")).agg(F.count("*").alias("n"))
    for run in (1, 2):
        so.append_results(rows.withColumn("run", F.lit(run)), path)
    return so.read_parquet(spark, path).groupBy("model").agg(F.max("n").alias("n"), F.count("*").alias("runs"))


@query(q(o.SPLITS, select="SELECT split_user AS model, CASE WHEN split_user = 'val' THEN 2 * count(*) ELSE count(*) END AS n FROM splits GROUP BY split_user"))
def replace_in_place(spark, d):
    """The rows of one key are replaced by what is read from them."""
    path = shared_path(spark, "replaced")
    rows = Data(spark, d).splits.groupBy(F.col("split_user").alias("model")).agg(F.count("*").alias("n"))
    so.replace_key(spark, path, rows, "model", "none")
    twice = so.read_parquet(spark, path).where("model = 'val'").withColumn("n", 2 * F.col("n"))
    so.replace_key(spark, path, twice, "model", "val")
    return so.read_parquet(spark, path)


@query(q(o.SPLITS, o.train(), o.ITEMS, select="""SELECT 'items' AS name, count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT item_id, count(*) AS c FROM train GROUP BY item_id)
UNION ALL SELECT 'users', count(*), sum(c)::BIGINT FROM (SELECT user_id, count(*) AS c FROM train GROUP BY user_id)
UNION ALL SELECT 'user_genres', count(*), sum(c)::BIGINT FROM (SELECT user_id, genre, count(*) AS c FROM liked JOIN item_genres USING (item_id) GROUP BY user_id, genre)
UNION ALL SELECT 'splits', count(*), sum(item_id)::BIGINT FROM splits"""))
def feature_handoff(spark, d):
    """The four tables that the feature pipeline hands on."""
    path = shared_path(spark, "features")
    feature_pipeline(views.ratings(spark, d), views.items(spark, d), path)
    t = {n: so.read_parquet(spark, f"{path}/{n}") for n in ("items", "users", "user_genres", "splits")}
    genres = t["user_genres"].join(t["users"].select("user_id", "n_positives"), "user_id").withColumn("x", F.round(F.col("share") * F.col("n_positives")))
    of = lambda df, name, c: df.agg(F.count("*").alias("n"), F.sum(c).cast("bigint").alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return of(t["items"], "items", "n_ratings").unionByName(of(t["users"], "users", "n_ratings")).unionByName(of(genres, "user_genres", "x")).unionByName(of(t["splits"], "splits", "item_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS config FROM events")
def json_configs(spark, d):
    """Settings to JSON and back: to_json and from_json with a schema."""
    events = spark.read.parquet(f"{d}/events.parquet")
    config = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind")))
    back = F.from_json(config, "event bigint, kind string")
    props = F.from_json("props", "k bigint")
    return events.select(back["event"].alias("event_id"), props["k"].alias("k"), config.alias("config"))


@query(q(o.RATINGS, select="SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%B %Y') AS month, count(*) AS n, min(ts) AS first_ts FROM ratings GROUP BY 1"))
def ratings_by_month(spark, d):
    month = F.date_format(F.timestamp_seconds("ts"), "MMMM yyyy")
    return views.ratings(spark, d).groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT p_partkey AS item_id, regexp_replace(p_type || '/' || p_name, '[^A-Za-z0-9_-]', '_', 'g') AS run_id FROM part")
def run_ids(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").alias("item_id"), safe_run_id_column(F.concat_ws("/", "p_type", "p_name")).alias("run_id"))


# ---- evaluation

@query(q(*_POP, o.user_metrics(), o.negatives(100), o.auc("pop_scores"), "hot AS (SELECT item_id FROM liked GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 1)",
    "gone AS (SELECT user_id FROM seen JOIN hot USING (item_id))", "kept_users AS (SELECT user_id FROM pop EXCEPT SELECT user_id FROM gone)", "shown AS (SELECT DISTINCT item_id FROM top SEMI JOIN kept_users USING (user_id))",
    "log AS (SELECT user_id, max((split_user = 'train' AND rating >= 4)::INT) AS t, max((split_user = 'val' AND rating >= 4)::INT) AS h FROM splits GROUP BY user_id)",
    select="""SELECT (SELECT count(*) FROM kept_users) AS n_users, (SELECT round(avg(recall), 6) FROM metrics SEMI JOIN kept_users USING (user_id)) AS recall, (SELECT round(avg(ndcg), 6) FROM metrics SEMI JOIN kept_users USING (user_id)) AS ndcg,
(SELECT round(avg(auc), 6) FROM aucs SEMI JOIN kept_users USING (user_id)) AS auc, (SELECT count(*) FROM shown) AS n_items_recommended, (SELECT count(*) FROM shown SEMI JOIN pool USING (item_id)) AS n_covered, (SELECT count(*) FROM pool) AS n_train_items,
round((SELECT count(*) FROM shown SEMI JOIN pool USING (item_id)) / (SELECT count(*) FROM pool), 6) AS coverage, (SELECT count(*) FROM gone) AS skipped_all_seen,
count(*) FILTER (t = 0) AS excluded_no_train_positive, count(*) FILTER (t = 1 AND h = 0) AS excluded_no_target_positive FROM log"""))
def evaluation_summary(spark, d):
    """The whole summary of popularity, with the most popular item alone as the catalogue of which a
    user can have seen everything: so the rule that leaves users out has something to do."""
    data, e, top = _popular(spark, d)
    popular = data.popular()
    catalog = popular.orderBy(F.col("score").desc(), "item_id").limit(1).select("item_id")
    auc = ev.auc_of(e.relevant.join(popular, "item_id"), ev.negatives(e).join(popular, "item_id"))
    return ev.summary(top, e, data.splits, catalog, auc)


# ---- statistics of reports

_W = "CASE " + " ".join(f"WHEN u < {e!r} THEN {n}" for n, e in enumerate(st._POISSON)) + f" ELSE {len(st._POISSON)} END"


def _resampled(name: str, run: str, seed: int) -> str:
    draws = f"SELECT r, ndcg, {o.H(str(seed), 'r', 'user_id')} / 4294967296 AS u FROM {run}, (SELECT unnest(range(1, {st.REPORT_REPLICATES + 1})) AS r)"
    return f"{name} AS (SELECT r, sum(w * ndcg) / sum(w) AS m FROM (SELECT r, ndcg, {_W} AS w FROM ({draws})) GROUP BY r)"


@query(q(*_TEST, _RND, _resampled("one", "metrics", 0), _resampled("two", "ndcg_b", 1), select="""SELECT round((SELECT avg(ndcg) FROM metrics) / (SELECT avg(ndcg) FROM ndcg_b), 6) AS ratio,
round(quantile_cont(one.m / two.m, 0.025), 6) AS lo, round(quantile_cont(one.m / two.m, 0.975), 6) AS hi FROM one JOIN two USING (r)"""))
def ratio_interval(spark, d):
    return st.ratio_interval(*_runs(spark, d), "ndcg")


_SEED_ROWS = "runs AS (SELECT 'm' || (seed % 2) AS model, seed, user_id, " + o.H("seed", "user_id") + " / 4294967296 AS v FROM pop, (SELECT unnest([42, 43, 44, 45]) AS seed))"


def _seed_rows(spark, d):
    seeds = F.explode(F.array(*[F.lit(s) for s in (42, 43, 44, 45)])).alias("seed")
    runs = Data(spark, d).eval().population.select("user_id", seeds)
    return runs.select(F.concat(F.lit("m"), F.pmod("seed", F.lit(2))).alias("model"), "seed", "user_id", (key_hash("seed", "user_id") / F.lit(float(1 << 32))).alias("v"))


@query(q(o.SPLITS, o.evaluation(), _SEED_ROWS, select="SELECT model, user_id, round(avg(v), 9) AS v FROM runs GROUP BY model, user_id"))
def mean_over_seeds(spark, d):
    return st.mean_over_seeds(_seed_rows(spark, d), "v").withColumn("v", F.round("v", 9))


@query(q(o.SPLITS, o.evaluation(), _SEED_ROWS, select="SELECT user_id, round(avg(v) FILTER (model = 'm0'), 9) AS m0, round(avg(v) FILTER (model = 'm1'), 9) AS m1 FROM runs GROUP BY user_id"))
def pivoted_models(spark, d):
    means = st.mean_over_seeds(_seed_rows(spark, d), "v").withColumn("v", F.round("v", 9))
    return st.pivoted(means, "user_id", "model", ["m0", "m1"], "v")


@query(q(*_POP, "moved AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY " + o.H("3", "user_id", "item_id") + ", item_id) AS rank FROM top)",
    select="SELECT a.user_id, count(*) / 10 AS share, count(*) FILTER (a.rank = b.rank) = 10 AS same_order FROM top a JOIN (SELECT * FROM moved WHERE rank <= 7) b USING (user_id, item_id) GROUP BY a.user_id"))
def list_overlap(spark, d):
    """Two lists of one user: the popular one, and seven of it in another order."""
    from ..functions import first_per_group

    top = _popular(spark, d)[2]
    moved = first_per_group(top.select("user_id", "item_id"), ["user_id"], [key_hash(3, "user_id", "item_id"), F.col("item_id")], 7)
    return st.overlap(top, moved, 10)


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99, round(max(value), 9) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return st.latency_percentiles(events).select("stage", *[F.round(c, 9).alias(c) for c in ("p50", "p90", "p99", "most")])


# ---- ranking

_NEAR = [o.gram(8), o.knn(20, 10.0)]


@query(q(*_CAND[:4], o.POPULAR, "own_seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores", rk.CANDIDATES, "cand", "own_seen"), *_NEAR,
    "near AS (SELECT l.user_id, sim.j AS item_id, round(sum(s), 9) AS ease_score FROM liked l JOIN sim ON l.item_id = sim.i GROUP BY 1, 2)",
    select="SELECT user_id, item_id, cand.rank - 1 AS retriever_rank, ease_score, row_number() OVER (PARTITION BY user_id ORDER BY ease_score DESC NULLS LAST, cand.rank) - 1 AS ease_rank FROM cand LEFT JOIN near USING (user_id, item_id)"))
def second_score_rank(spark, d):
    """Candidates with a second model's score and its place among them; what it can't score comes last."""
    data, _, cands = _candidates(spark, d, rk.CANDIDATES)
    liked = mo.likes(data.train())
    near = mo.history_scores(liked, mo.knn_similarity(mo.item_gram(liked, 8), 20, 10.0)).select("user_id", "item_id", F.round("score", 9).alias("ease_score"))
    return rk.rank_among(cands.join(near, ["user_id", "item_id"], "left"), "ease_score", "ease_rank").select("user_id", "item_id", "retriever_rank", "ease_score", "ease_rank")


@query(q(o.SPLITS, o.evaluation(), o.train(), select=f"SELECT user_id FROM (SELECT user_id FROM liked INTERSECT SELECT user_id FROM relevant) ORDER BY {o.H('0', 'user_id')}, user_id LIMIT 200"))
def ranker_users(spark, d):
    data = Data(spark, d)
    return rk.ranker_users(data.train(), data.eval().relevant, 200)


@query(q(o.SPLITS, o.train(), select="SELECT count(*) FILTER (user_id % 10 = 3)::BIGINT AS unmatched, 0.25::DOUBLE AS max_gap FROM (SELECT DISTINCT user_id, item_id FROM train)"))
def feature_parity(spark, d):
    """Features of two builds that differ where faults were planted: pairs of some users are missing
    in one, and some values are 0.25 higher."""
    pairs = Data(spark, d).train().select("user_id", "item_id", F.col("rating").alias("x"), F.lit(None).cast("double").alias("y"))
    other = pairs.where("user_id % 10 <> 3").withColumn("x", F.col("x") + F.when(F.col("user_id") % 10 == 7, 0.25).otherwise(0.0))
    return rk.feature_gap(pairs, other, ["x", "y"])


# ---- planted faults: the checks that find nothing in good data must find these

_FAULTY = """faulty AS (SELECT user_id, item_id, ts, n, CASE WHEN user_id % 11 = 0 AND split_user = 'val' THEN 'vall' ELSE split_user END AS split_user,
CASE WHEN user_id % 13 = 0 THEN NULL ELSE train_part END AS train_part, CASE WHEN user_id % 17 = 0 THEN 'train' ELSE split_global END AS split_global, split_random
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM splits) WHERE user_id % 19 <> 0)"""


@query(q(o.SPLITS, _FAULTY, select="""SELECT 'label_user' AS rule, count(*) FILTER (split_user = 'vall')::BIGINT AS violations FROM faulty UNION ALL SELECT 'label_global', 0 UNION ALL SELECT 'label_random', 0
UNION ALL SELECT 'row_total', (SELECT count(*) FROM splits) - count(*) FROM faulty UNION ALL SELECT 'train_part', count(*) FILTER (split_user = 'train' AND train_part IS NULL) FROM faulty
UNION ALL SELECT 'global_bounds', count(*) FILTER (split_global = 'train' AND ts > t80) FROM faulty, cuts"""))
def planted_split_faults(spark, d):
    data = Data(spark, d)
    cuts = sp.global_cutoffs(data.ratings).first()
    u = F.col("user_id")
    faulty = data.splits.where(u % 19 != 0).withColumns({
        "split_user": F.when((u % 11 == 0) & (F.col("split_user") == "val"), "vall").otherwise(F.col("split_user")),
        "train_part": F.when(u % 13 != 0, F.col("train_part")),
        "split_global": F.when(u % 17 == 0, "train").otherwise(F.col("split_global")),
    })
    return sp.split_violations(faulty, data.ratings.count(), cuts["t80"], cuts["t90"]).where("rule not in ('time_order', 'small_users')")


@query(q(o.SPLITS, o.train(), select="SELECT count(DISTINCT item_id) FILTER (item_id % 7 = 0)::BIGINT AS only_left, count(DISTINCT item_id) FILTER (item_id % 7 = 0 AND item_id % 2 = 0)::BIGINT AS only_right FROM train"))
def planted_engine_faults(spark, d):
    """Outputs of two engines, one of which lost some rows and changed others."""
    good = fe.item_features(Data(spark, d).train())
    i = F.col("item_id")
    bad = good.where((i % 7 != 0) | (i % 2 == 0)).withColumn("mean_rating", F.col("mean_rating") + F.when(i % 7 == 0, 0.5).otherwise(0.0))
    return st.same_output(good, bad)


# ---- bundles

@query(q(o.SPLITS, select="SELECT 'splits' AS name, count(*) AS n, 'item_id bigint, user_id bigint' AS columns FROM splits"))
def bundle_manifest(spark, d):
    """What a bundle's manifest says about its table, read as JSON."""
    from .serving import export_bundle

    folder = shared_path(spark, "bundle")
    export_bundle(folder, {"splits": Data(spark, d).splits.select("user_id", "item_id")}, {"origin": "test"})
    told = so.get_json(spark, f"{folder}/manifest.json")["tables"]
    return spark.createDataFrame([(n, t["rows"], ", ".join(f"{c} {k}" for c, k in sorted(t["columns"].items()))) for n, t in told.items()], "name string, n bigint, columns string")


@query(q(o.SPLITS, o.train(), o.POPULAR, "pop AS (SELECT n_nationkey::BIGINT AS user_id FROM nation)", "seen AS (SELECT DISTINCT user_id, item_id FROM train)",
    "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores"), select="SELECT user_id, item_id, rank FROM top"))
def served_requests(spark, d):
    """Answers to single requests, from a bundle that has no ranked rows: what is popular and unseen.
    The requests are the keys of the table nation, some of known users."""
    from .serving import MAX_K, Recommender, export_bundle, profiles

    data = Data(spark, d)
    train = data.train()
    seen = train.select("user_id", "item_id").distinct()
    most = seen.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    folder = shared_path(spark, "served")
    export_bundle(folder, {"seen": seen, "profiles": profiles(train), "popular": mo.popular_list(data.popular(), most + MAX_K)}, {"origin": "test"})
    service = Recommender(spark, folder)
    service.warm_up()
    asked = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]  # requests, one after the other
    rows = [(u, i, n + 1) for u in asked for n, i in enumerate(service.recommend(u)["items"])]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rank bigint")


# ---- the chain of two stages

@query()
def two_stage_summary(spark, d):
    """Two-tower candidates, all features with EASE's, LambdaMART, adapted scores: judged on val."""
    from .two_stage import TwoStage

    data = Data(spark, d)
    e = data.eval()
    scores = written(TwoStage().fit(data.splits, data.items, data.relevance).scores(e.population), "two-stage")
    auc = ev.user_auc(scores, e, ev.negatives(e))
    return ev.summary(ev.top_k(ev.mask_seen(ev.validated(scores), e.seen)), e, data.splits, data.catalog, auc)


@query(q(*_CAND[:4], o.POPULAR, "own_seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores", rk.CANDIDATES, "cand", "own_seen"), *_NEAR,
    "near AS (SELECT l.user_id, sim.j AS item_id, sum(s) AS score FROM liked l JOIN sim ON l.item_id = sim.i GROUP BY 1, 2)", "known AS (SELECT DISTINCT j AS item_id FROM sim)",
    select="SELECT user_id, item_id, round(coalesce(near.score, 0), 6) AS score FROM cand SEMI JOIN known USING (item_id) LEFT JOIN near USING (user_id, item_id)"))
def history_pair_scores(spark, d):
    """Weights summed over histories for candidates alone: here the neighbours' weights, as EASE's go."""
    data, _, cands = _candidates(spark, d, rk.CANDIDATES)
    liked = mo.likes(data.train())
    weights = written(mo.knn_similarity(mo.item_gram(liked, 8), 20, 10.0), "neighbours")
    return mo.ease_pair_scores(liked, weights, cands).withColumn("score", F.round("score", 6))


# ---- models, where SQL can say what must come out

#: So large that EASE's weights are co-occurrence counts over it, to nine digits: scores are sums of counts.
_LIMIT = 1e9


def _limit_sql(history: str) -> str:
    return q(o.SPLITS, o.evaluation(), o.train(), o.gram(10), f"hist AS ({history})",
        "sums AS (SELECT u.user_id, k.item_id, coalesce(s, 0) AS score FROM (SELECT DISTINCT user_id FROM hist SEMI JOIN pop USING (user_id)) u CROSS JOIN kept k LEFT JOIN (SELECT h.user_id, g.j AS item_id, sum(g.n) AS s FROM hist h JOIN gram g ON h.item_id = g.i WHERE g.i <> g.j GROUP BY 1, 2) x ON x.user_id = u.user_id AND x.item_id = k.item_id)",
        o.top("sums"), select="SELECT user_id, rank, score::BIGINT AS total FROM top")


def _limit(spark, d, history):
    data = Data(spark, d)
    e = data.eval()
    liked = mo.likes(data.train())
    top = Ease(liked, 10, _LIMIT).top_k(history(data, liked).join(e.population, "user_id", "left_semi"), e.seen)
    return top.select("user_id", "rank", F.round(F.col("score") * _LIMIT).cast("bigint").alias("total"))


@query(_limit_sql("SELECT user_id, item_id FROM liked"))
def ease_limit_scores(spark, d):
    """EASE from weights to lists, in the limit where its scores are whole numbers."""
    return _limit(spark, d, lambda data, liked: liked)


@query(_limit_sql("SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r FROM liked) WHERE r <= 10"))
def ease_recent_limit_scores(spark, d):
    """The same of each user's last ten positives."""
    return _limit(spark, d, lambda data, liked: mo.recent_history(data.train(), 10))


@query(q(o.SPLITS, o.train(), select="SELECT user_id, count(DISTINCT item_id) AS n FROM liked GROUP BY user_id"))
def als_recovered_counts(spark, d):
    """How many positives a user has, read off the fitted factors: a user's factor x solves
    (Y'Y + alpha * sum y y' + reg * n * I) x = (1 + alpha) * sum y over the n liked items' factors y."""
    import numpy as np
    import pandas as pd

    reg, alpha = 0.1, 5.0
    liked = mo.likes(Data(spark, d).train())
    model = mo.als_factors(liked, reg=reg, alpha=alpha)
    items = written(model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.col("features").alias("y")), "als-items")
    cells = items.select(F.posexplode("y").alias("a", "p"), "y").select("a", "p", F.posexplode("y").alias("b", "q")).groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("g"))
    gram = np.zeros((model.rank, model.rank))
    for r in cells.collect():  # rank times rank numbers
        gram[r["a"], r["b"]] = r["g"]
    own = liked.join(items, "item_id").groupBy("user_id").agg(F.flatten(F.collect_list("y")).alias("ys"))
    users = model.userFactors.select(F.col("id").cast("bigint").alias("user_id"), F.col("features").alias("x")).join(own, "user_id")

    def count(batches):
        for batch in batches:
            out = []
            for x, ys in zip(batch["x"], batch["ys"], strict=True):
                x, y = np.asarray(x, float), np.asarray(ys, float).reshape(-1, len(x))
                rest = (1 + alpha) * y.sum(0) - gram @ x - alpha * y.T @ (y @ x)
                out.append(round(float(rest @ x / (reg * (x @ x)))))
            yield pd.DataFrame({"user_id": batch["user_id"], "n": out})

    return users.mapInPandas(count, "user_id bigint, n bigint")


@query(q(o.SPLITS, o.evaluation(), o.train(), "e AS (SELECT p_partkey AS item_id, cos(p_partkey * (0.7 + p_partkey * 0.0001)) AS x, sin(p_partkey * (0.7 + p_partkey * 0.0001)) AS y FROM part)",
    "hist AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r FROM liked) WHERE r <= 10)",
    "u AS (SELECT user_id, avg(x) AS x, avg(y) AS y FROM hist JOIN e USING (item_id) SEMI JOIN pop USING (user_id) GROUP BY user_id)",
    "sims AS (SELECT u.user_id, e.item_id, (u.x * e.x + u.y * e.y) / sqrt(u.x * u.x + u.y * u.y) AS score FROM u, e)", o.top("sims"), select="SELECT user_id, item_id, rank, round(score, 6) AS score FROM top"))
def retrieved_by_direction(spark, d):
    """The retriever's scoring of the whole catalogue, of a model whose embeddings are directions in a plane."""
    import numpy as np

    from .retriever import TwoTower

    data = Data(spark, d)
    e = data.eval()
    model = TwoTower(dim=2, hidden=1)
    model.items = np.sort(data.catalog.distinct().toPandas()["item_id"].to_numpy(np.int64))
    angle = model.items * (0.7 + model.items * 0.0001)  # no two items lie alike on both sides of a third
    plane = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    model.weights = {"e": np.concatenate([plane, np.zeros((1, 2))]), "w1": np.zeros((2, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 2)), "b2": np.zeros(2)}
    return model.top_k(data.train(), e.population, e.seen).withColumn("score", F.round("score", 6))


_GAIN = "CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END"


@query(q(*_CAND[:4], o.POPULAR, "own_seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores", rk.CANDIDATES, "cand", "own_seen"),
    f"s AS (SELECT c.user_id, c.item_id, (r.item_id IS NOT NULL)::INT AS label, {o.H('9', 'c.user_id', 'c.item_id')} / 4294967296 AS score FROM cand c LEFT JOIN relevant r ON r.user_id = c.user_id AND r.item_id = c.item_id)",
    f"l AS (SELECT *, {_GAIN} AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, sum(label) OVER (PARTITION BY user_id) AS n FROM s))",
    """w AS (SELECT p.user_id, p.item_id AS pi, t.item_id AS ti, abs(p.g - t.g) / list_sum(list_transform(range(1, least(p.n, 10)::BIGINT + 1), lambda r: 1 / log2(r + 1))) AS sw, 1 / (1 + exp(p.score - t.score)) AS rho
FROM l p JOIN l t ON p.user_id = t.user_id WHERE p.label = 1 AND t.label = 0)""",
    "x AS (SELECT user_id, pi AS item_id, sw * rho AS d, sw * rho * (1 - rho) AS h FROM w UNION ALL SELECT user_id, ti, -sw * rho, sw * rho * (1 - rho) FROM w)",
    select="SELECT user_id, item_id, label, round(coalesce(sum(d), 0), 9) + 0.0 AS grad, round(coalesce(sum(h), 0), 9) AS hess FROM (SELECT * FROM l WHERE n > 0) LEFT JOIN x USING (user_id, item_id) GROUP BY user_id, item_id, label"))
def lambda_gradients(spark, d):
    """What the boosted trees are fitted to: gradients and curvatures of the pairwise, NDCG-weighted loss."""
    from .ranker import lambdas

    _, e, cands = _candidates(spark, d, rk.CANDIDATES)
    rows = rk.labelled(cands, e.relevant).select("user_id", "item_id", "label", (key_hash(9, "user_id", "item_id") / F.lit(float(1 << 32))).alias("score"))
    return lambdas(rows).select("user_id", "item_id", "label", (F.round("grad", 9) + 0.0).alias("grad"), F.round("hess", 9).alias("hess"))
