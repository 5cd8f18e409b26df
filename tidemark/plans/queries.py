"""The registered queries: each operator over whole tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import first_per_group
from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import models as mo
from ..operators import ranking as rk
from ..operators import sequences as sq
from ..operators import splits as sp
from ..operators import statistics as st
from ..operators.ease import Ease
from ..sources import replace_rows, views, written, written_at
from . import oracles as o
from .oracles import q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


class Data:
    """The views of one folder in one session. The splits are kept: nearly every query starts from them."""

    _last: tuple | None = None

    def __new__(cls, spark: SparkSession, sf_dir: str) -> Data:
        # Files that were written anew are another folder.
        key = (spark.sparkContext.applicationId, sf_dir, *[written_at(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part")])
        if cls._last is None or cls._last[0] != key:
            if cls._last is not None and cls._last[0][0] == key[0]:
                cls._last[1].release()
            cls._last = (key, super().__new__(cls))
        return cls._last[1]

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        if not hasattr(self, "spark"):
            self.spark, self.sf_dir = spark, sf_dir
            self.ratings = views.ratings(spark, sf_dir)
            self.items, self.relevance = views.items(spark, sf_dir), views.relevance(spark, sf_dir)
            self._splits: DataFrame | None = None

    @property
    def splits(self) -> DataFrame:
        if self._splits is None:
            self._kept = self.ratings.cache()
            self._splits = sp.build_splits(self._kept).cache()
        return self._splits

    def release(self) -> None:
        """Let go of what is kept; it is worked out again if it is asked for."""
        if self._splits is not None:
            self._splits.unpersist()
            self._kept.unpersist()
            self._splits = None

    def train(self, name: str = "train") -> DataFrame:
        return sp.training_set(self.splits, name)

    def eval(self, target: str = "val", scheme: str = "user") -> ev.EvalData:
        return ev.eval_data(self.splits, scheme, target)

    @property
    def catalog(self) -> DataFrame:
        return self.items.select("item_id")

    def popular(self, name: str = "train") -> DataFrame:
        return mo.popularity(mo.likes(self.train(name)), self.catalog)


# ---- views and splits

@query(f"WITH {o.RATINGS} SELECT * FROM ratings")
def ratings_view(spark, d):
    return views.ratings(spark, d)


@query("""WITH r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, value, epoch(ts) AS t, event_id FROM events)
SELECT user_id, item_id, (floor(value)::BIGINT % 10 + 1) / 2 AS rating, floor(t)::BIGINT AS ts FROM r WHERE item_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY t, event_id) = 1""")
def ratings_events_view(spark, d):
    return views.ratings_events(spark, d)


@query(f"WITH {o.RELEVANCE} SELECT * FROM relevance")
def genome_long(spark, d):
    return views.relevance(spark, d)


@query(q(o.SPLITS, select="SELECT user_id, item_id, rating, ts, split_user, train_part FROM splits"))
def per_user_split(spark, d):
    return sp.per_user_split(views.ratings(spark, d))


@query(q(o.SPLITS, select="SELECT user_id, item_id, ts, split_global FROM splits"))
def global_split(spark, d):
    return Data(spark, d).splits.select("user_id", "item_id", "ts", "split_global")


@query(q(o.SPLITS, select="SELECT t80, t90 FROM cuts"))
def global_cutoffs(spark, d):
    return sp.global_cutoffs(views.ratings(spark, d))


@query(q(o.SPLITS, select="SELECT user_id, item_id, split_random FROM splits"))
def random_split(spark, d):
    return sp.random_split(views.ratings(spark, d)).select("user_id", "item_id", "split_random")


@query()
def random_split_xx(spark, d):
    return sp.random_split(views.ratings(spark, d), engine_hash=True).select("user_id", "item_id", "split_random")


for _s in sp.SCHEMES:
    query(q(o.SPLITS, select=f"SELECT split_{_s} AS split, count(*) AS n FROM splits GROUP BY 1"), f"split_counts_{_s}")(lambda spark, d, s=_s: sp.split_counts(Data(spark, d).splits, s))
    query(q(o.SPLITS, select=f"""SELECT count(*) AS users_total, sum(a)::BIGINT AS users_eligible, sum(1 - a)::BIGINT AS users_excluded, sum(a * b)::BIGINT AS eligible_with_val, sum(a * c)::BIGINT AS eligible_with_test
FROM (SELECT max((split_{_s} = 'train' AND rating >= 4)::INT) AS a, max((split_{_s} = 'val' AND rating >= 4)::INT) AS b, max((split_{_s} = 'test' AND rating >= 4)::INT) AS c FROM splits GROUP BY user_id)"""), f"split_user_stats_{_s}")(lambda spark, d, s=_s: sp.split_user_stats(Data(spark, d).splits, s))
    query(q(o.SPLITS, select=f"SELECT sum({o.H('user_id', 'item_id', f'split_{_s}')} % 1000000007)::BIGINT AS fingerprint FROM splits"), f"split_fingerprint_{_s}")(lambda spark, d, s=_s: sp.fingerprint(Data(spark, d).splits, s))


@query("SELECT unnest(['label_user', 'label_global', 'label_random', 'row_total', 'train_part', 'global_bounds', 'time_order', 'small_users']) AS rule, 0::BIGINT AS violations")
def split_violations(spark, d):
    data = Data(spark, d)
    splits, n = data.splits, data.ratings.count()
    cuts = sp.global_cutoffs(data.ratings).first()
    return sp.split_violations(splits, n, cuts["t80"], cuts["t90"])


_BOUNDS = "b AS (SELECT user_id, " + ", ".join(f"{f}(ts) FILTER (split_user = '{s}') AS {s}_{n}" for s in ("train", "val", "test") for n, f in (("lo", "min"), ("hi", "max"))) + " FROM splits GROUP BY user_id)"


@query(q(o.SPLITS, _BOUNDS, select="""SELECT round(avg((test_hi - test_lo <= 3600)::INT), 6) AS test_span_1h, round(avg((test_hi - test_lo <= 86400)::INT), 6) AS test_span_24h,
round(quantile_cont((test_hi - test_lo) / 3600.0::DOUBLE, 0.5), 6) AS test_span_median_h, count(*) FILTER (val_lo = train_hi) AS cut_same_second, round(avg((val_lo - train_hi <= 3600)::INT), 6) AS cut_1h_share FROM b"""))
def burst_stats(spark, d):
    return sp.burst_stats(Data(spark, d).splits)


@query(q(o.SPLITS, o.ITEMS, o.RELEVANCE, select="""SELECT (SELECT count(*) FROM items) AS items_total, (SELECT count(DISTINCT item_id) FROM splits) AS items_rated,
(SELECT count(DISTINCT item_id) FROM splits WHERE split_user = 'train') AS items_in_train,
(SELECT count(DISTINCT item_id) FROM splits WHERE item_id NOT IN (SELECT item_id FROM splits WHERE split_user = 'train')) AS items_only_held_out,
(SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM relevance)) AS items_described"""))
def catalog_stats(spark, d):
    data = Data(spark, d)
    return sp.catalog_stats(data.splits, data.items, data.relevance)


# ---- features of the three training sets

for _t in sp.TRAINING_SETS:
    _sum = "count(*) AS n_ratings, count(*) FILTER (rating >= 4) AS n_positives, avg(rating) AS mean_rating"
    query(q(o.SPLITS, o.train(_t), select=f"SELECT item_id, {_sum}, min(ts) AS first_rated_ts, max(ts) AS last_rated_ts FROM train GROUP BY item_id"), f"item_features_{_t}")(lambda spark, d, t=_t: fe.item_features(Data(spark, d).train(t)))
    query(q(o.SPLITS, o.train(_t), select=f"SELECT user_id, {_sum}, max(ts) AS last_rated_ts FROM train GROUP BY user_id"), f"user_features_{_t}")(lambda spark, d, t=_t: fe.user_features(Data(spark, d).train(t)))
    query(q(o.SPLITS, o.train(_t), o.ITEMS, select="""SELECT user_id, genre, count(*) / any_value(n) AS share FROM liked JOIN item_genres USING (item_id)
JOIN (SELECT user_id, count(*) AS n FROM liked GROUP BY user_id) USING (user_id) GROUP BY user_id, genre"""), f"user_genres_{_t}")(lambda spark, d, t=_t: fe.user_genres(Data(spark, d).train(t), Data(spark, d).items))


@query(f"WITH {o.RELEVANCE} SELECT item_id, list(relevance ORDER BY tag_id) AS vector FROM relevance GROUP BY item_id")
def genome_vectors(spark, d):
    return fe.content_vectors(views.relevance(spark, d))


# ---- evaluation protocol

@query(q(o.SPLITS, o.evaluation(), select="SELECT user_id FROM pop"))
def eval_population(spark, d):
    return Data(spark, d).eval().population


@query(q(o.SPLITS, o.evaluation("test"), select="SELECT user_id, count(*) AS n FROM seen GROUP BY user_id"))
def eval_seen_counts(spark, d):
    return Data(spark, d).eval("test").seen.groupBy("user_id").agg(F.count("*").alias("n"))


@query(q(o.SPLITS, o.evaluation("test", "global"), select="SELECT user_id, item_id FROM relevant"))
def eval_relevant(spark, d):
    return Data(spark, d).eval("test", "global").relevant


@query(q(o.SPLITS, o.evaluation(), select="SELECT count(*) AS n FROM pool"))
def coverage_denominator(spark, d):
    return Data(spark, d).eval().train_items.agg(F.count("*").alias("n"))


@query(q(o.SPLITS, o.evaluation(), o.negatives(100), select="SELECT user_id, item_id FROM drawn"))
def eval_negatives(spark, d):
    return ev.negatives(Data(spark, d).eval())


@query(q(o.SPLITS, o.evaluation(), select=f"SELECT user_id FROM pop ORDER BY {o.H('0', 'user_id')}, user_id LIMIT 50"))
def user_subsample(spark, d):
    return ev.subsample(Data(spark, d).eval().population, 50)


_POP = [o.SPLITS, o.evaluation(), o.train(), o.POPULAR, "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores")]


def _popular(spark, d, target="val"):
    data = Data(spark, d)
    e = data.eval(target)
    return data, e, mo.popular_top_k(data.popular(), e.population, e.seen)


@query(q(*_POP, select="SELECT user_id, item_id, score, rank FROM top"))
def popular_topk(spark, d):
    return _popular(spark, d)[2]


@query(q(*_POP, o.user_metrics(), select="SELECT user_id, n_relevant, hits::BIGINT AS hits, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM metrics"))
def popular_user_metrics(spark, d):
    _, e, top = _popular(spark, d)
    return ev.user_metrics(top, e).withColumns({"recall": F.round("recall", 6), "ndcg": F.round("ndcg", 6)})


@query(q(*_POP, o.user_metrics(), o.negatives(100), o.auc("pop_scores"), select="SELECT count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(auc), 6) AS auc FROM metrics LEFT JOIN aucs USING (user_id)"))
def popular_metrics(spark, d):
    data, e, top = _popular(spark, d)
    drawn = ev.negatives(e)
    # Only the pairs that AUC asks for are scored, never users times catalogue.
    popular = data.popular().cache()
    auc = ev.auc_of(e.relevant.join(popular, "item_id"), drawn.join(popular, "item_id"))
    users = ev.user_metrics(top, e).join(auc, "user_id", "left")
    return users.agg(F.count("*").alias("n_users"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "ndcg", "auc")])


@query(q(*_POP, select="""SELECT (SELECT count(DISTINCT item_id) FROM top) AS n_items_recommended, (SELECT count(DISTINCT item_id) FROM top SEMI JOIN pool USING (item_id)) AS n_covered,
(SELECT count(*) FROM pool) AS n_train_items, round((SELECT count(DISTINCT item_id) FROM top SEMI JOIN pool USING (item_id)) / (SELECT count(*) FROM pool), 6) AS coverage"""))
def coverage(spark, d):
    _, e, top = _popular(spark, d)
    return ev.coverage(top, e)


@query(q(o.SPLITS, o.evaluation(), select="SELECT count(*) AS n_users, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS ndcg, 1.0::DOUBLE AS auc FROM pop"))
def oracle_metrics(spark, d):
    e = Data(spark, d).eval()
    return ev.evaluate(ev.oracle_scores(e), e, ev.negatives(e))


@query(q(o.SPLITS, o.evaluation(), o.negatives(100), f"asked AS (SELECT * FROM relevant UNION SELECT * FROM drawn), rnd AS (SELECT user_id, item_id, {o.H('0', 'user_id', 'item_id')} / 4294967296 AS score FROM asked)", o.top("rnd"), o.user_metrics(), o.auc("rnd"), select="SELECT count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(auc), 6) AS auc FROM metrics LEFT JOIN aucs USING (user_id)"))
def random_metrics(spark, d):
    """Random scores for relevant and drawn items: how far chance gets on them."""
    e = Data(spark, d).eval()
    drawn = ev.negatives(e).cache()
    return ev.evaluate(ev.random_scores(e.relevant.unionByName(drawn)), e, drawn)


@query(q(*_POP[:4], "listed AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS p FROM pop_score)", "walk AS (SELECT user_id, item_id, -p::DOUBLE AS score FROM pop CROSS JOIN listed)", o.top("walk", 500, "cand"),
    select="SELECT k, round(avg(c / n), 6) AS ceiling FROM (SELECT user_id, k::BIGINT AS k, count(rank) FILTER (rank <= k) AS c, count(*) AS n FROM relevant LEFT JOIN cand USING (user_id, item_id), (SELECT unnest([50, 100, 200, 500]) AS k) GROUP BY ALL) GROUP BY k"))
def recall_ceiling(spark, d):
    data = Data(spark, d)
    e = data.eval()
    return ev.recall_ceiling(mo.popular_top_k(data.popular(), e.population, e.seen, 500), e)


# ---- models

_MIN = 8
_GRAM = [o.SPLITS, o.train(), o.gram(_MIN)]


def _gram(spark, d, least=_MIN):
    liked = mo.likes(Data(spark, d).train())
    return liked, mo.item_gram(liked, least)


@query(q(*_GRAM, select="SELECT i, j, n FROM gram"))
def item_gram(spark, d):
    return _gram(spark, d)[1]


_KNN = [o.SPLITS, o.evaluation(), o.train(), o.gram(_MIN), o.knn(20, 10.0)]


@query(q(*_KNN, select="SELECT i, j, round(s, 9) AS s FROM sim"))
def knn_similarity(spark, d):
    return mo.knn_similarity(_gram(spark, d)[1], 20, 10.0).withColumn("s", F.round("s", 9))


def _knn_top(spark, d):
    data = Data(spark, d)
    e = data.eval()
    liked, gram = _gram(spark, d)
    own = liked.join(e.population, "user_id", "left_semi")
    scores = mo.history_scores(own, mo.knn_similarity(gram, 20, 10.0)).withColumn("score", F.round("score", 9)).cache()
    return e, ev.top_k(ev.mask_seen(mo.fill_zero(scores, mo.kept_items(liked, _MIN), e.population, e.seen), e.seen))


@query(q(*_KNN, o.top("knn_score"), select="SELECT user_id, item_id, score, rank FROM top"))
def knn_topk(spark, d):
    return _knn_top(spark, d)[1].select("user_id", "item_id", "score", "rank")


@query(q(*_KNN, o.top("knn_score"), o.user_metrics(), select="SELECT count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM metrics"))
def knn_metrics(spark, d):
    e, top = _knn_top(spark, d)
    return ev.user_metrics(top, e).agg(F.count("*").alias("n_users"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


_EASE_MIN, _LAMBDA = 10, 50.0


@query(q(o.SPLITS, o.train(), o.gram(_EASE_MIN), select="SELECT i, j, n::DOUBLE AS x FROM gram WHERE i <> j"))
def ease_identity(spark, d):
    """(G + lambda I) B off the diagonal, which must be G."""
    return Ease(mo.likes(Data(spark, d).train()), _EASE_MIN, _LAMBDA).products()


@query()
def ease_topk(spark, d):
    data = Data(spark, d)
    e = data.eval()
    liked = mo.likes(data.train())
    return Ease(liked, _EASE_MIN, _LAMBDA).top_k(liked.join(e.population, "user_id", "left_semi"), e.seen)


@query()
def ease_recent_topk(spark, d):
    data = Data(spark, d)
    e = data.eval()
    history = mo.recent_history(data.train(), 10).join(e.population, "user_id", "left_semi")
    return Ease(mo.likes(data.train()), _EASE_MIN, _LAMBDA).top_k(history, e.seen)


@query(q(o.SPLITS, o.train(), select="SELECT DISTINCT item_id, 8::BIGINT AS rank FROM liked"))
def als_factor_items(spark, d):
    model = mo.als_factors(mo.likes(Data(spark, d).train()))
    return model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.size("features").cast("bigint").alias("rank"))


@query()
def als_topk(spark, d):
    data = Data(spark, d)
    e = data.eval()
    return mo.als_top_k(mo.als_factors(mo.likes(data.train())), e.population, e.seen).select("user_id", "item_id", "rank")


# ---- sequences

_SEQ = [o.SPLITS, o.train(), "seq AS (SELECT user_id, item_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS pos FROM liked)"]
_PAIRS = "pairs AS (SELECT user_id, pos, item_id AS target, list(item_id) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history FROM seq)"
_EPOCH = f"epoch AS (SELECT user_id, pos, target FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {o.H('7', 'user_id', 'pos')}, pos) AS r FROM pairs WHERE pos > 0) WHERE r <= 3)"


def _pairs(spark, d):
    return sq.training_pairs(sq.sequences(Data(spark, d).train()))


@query(q(*_SEQ, select="SELECT user_id, coalesce(items, []) AS items, coalesce(times, []) AS times FROM (SELECT DISTINCT user_id FROM train) LEFT JOIN (SELECT user_id, list(item_id ORDER BY pos) AS items, list(ts ORDER BY pos) AS times FROM seq GROUP BY user_id) USING (user_id)"))
def train_sequences(spark, d):
    return sq.sequence_arrays(Data(spark, d).train())


@query(q(*_SEQ, _PAIRS, select="SELECT user_id, pos, target, history FROM pairs WHERE pos > 0"))
def training_pairs(spark, d):
    return _pairs(spark, d)


@query(q(*_SEQ, "e AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM seq)", select="""SELECT e.user_id, e.pos, any_value(e.item_id) AS target, list(s.item_id ORDER BY s.pos) AS history
FROM e JOIN seq s ON s.user_id = e.user_id AND s.pos < e.n AND s.pos >= e.n - 10 GROUP BY e.user_id, e.pos"""))
def strict_histories(spark, d):
    return sq.strict_pairs(sq.sequences(Data(spark, d).train()))


@query(q(*_SEQ, _PAIRS, _EPOCH, select="SELECT user_id, pos, target FROM epoch"))
def epoch_cap(spark, d):
    return sq.epoch_sample(_pairs(spark, d), 3, 7).select("user_id", "pos", "target")


@query(q(*_SEQ, _PAIRS, _EPOCH, select="""SELECT p_partkey AS item_id, round(ln(greatest(coalesce(n, 0) / (SELECT count(*) FROM epoch), 1e-12)), 6) AS log_q
FROM part LEFT JOIN (SELECT target, count(*) AS n FROM epoch GROUP BY target) ON p_partkey = target"""))
def logq(spark, d):
    return sq.log_q(sq.epoch_sample(_pairs(spark, d), 3, 7).cache(), Data(spark, d).catalog).withColumn("log_q", F.round("log_q", 6))


# ---- candidates and features for ranking

_K = 20
_CAND = [o.SPLITS, o.evaluation(), o.train(), o.ITEMS, o.POPULAR, "own_seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores", _K, "cand", "own_seen")]


def _candidates(spark, d, k=_K):
    data = Data(spark, d)
    e = data.eval()
    top = mo.popular_top_k(data.popular(), e.population, data.train().select("user_id", "item_id"), k)
    return data, e, top.select("user_id", "item_id", F.col("score").alias("retriever_score"), (F.col("rank") - 1).alias("retriever_rank"))


def _context(data: Data) -> rk.Context:
    return rk.Context(data.train(), data.items, fe.content_vectors(data.relevance))


@query(q(*_CAND, select="SELECT user_id, item_id, score AS retriever_score, rank - 1 AS retriever_rank FROM cand"))
def candidates(spark, d, k=_K):
    return _candidates(spark, d, k)[2]


_STATS = """SELECT user_id, item_id, score AS retriever_score, rank - 1 AS retriever_rank, round(ln(1 + i.n), 9) AS item_log_n, round(ln(1 + i.p), 9) AS item_log_pos, i.m AS item_mean,
round((u.hi - i.hi) / 86400.0::DOUBLE, 9) AS item_days_since_last, round((u.hi - i.lo) / 86400.0::DOUBLE, 9) AS item_age_days, round(ln(1 + u.n), 9) AS user_log_n, round(ln(1 + u.p), 9) AS user_log_pos, u.m AS user_mean
FROM cand LEFT JOIN (SELECT item_id, count(*) AS n, count(*) FILTER (rating >= 4) AS p, avg(rating) AS m, min(ts) AS lo, max(ts) AS hi FROM train GROUP BY 1) i USING (item_id)
LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (rating >= 4) AS p, avg(rating) AS m, max(ts) AS hi FROM train GROUP BY 1) u USING (user_id)"""


@query(q(*_CAND, select=_STATS))
def rank_features_stats(spark, d, k=_K):
    data, _, cands = _candidates(spark, d, k)
    rounded = ["item_log_n", "item_log_pos", "item_days_since_last", "item_age_days", "user_log_n", "user_log_pos"]
    return rk.statistics_features(cands, data.train()).withColumns({c: F.round(c, 9) for c in rounded})


@query(q(*_CAND, select="""SELECT user_id, item_id, round(coalesce(sum(share), 0), 6) AS genre_overlap, round(coalesce(max(share), 0), 6) AS genre_max
FROM cand LEFT JOIN item_genres USING (item_id) LEFT JOIN (SELECT user_id, genre, count(*) / any_value(n) AS share FROM liked JOIN item_genres USING (item_id)
JOIN (SELECT user_id, count(*) AS n FROM liked GROUP BY user_id) USING (user_id) GROUP BY user_id, genre) USING (user_id, genre) GROUP BY user_id, item_id"""))
def genre_overlap(spark, d, k=_K):
    data, _, cands = _candidates(spark, d, k)
    out = rk.genre_features(cands, data.train(), data.items)
    return out.select("user_id", "item_id", F.round("genre_overlap", 6).alias("genre_overlap"), F.round("genre_max", 6).alias("genre_max"))


def _sim(history: str, name: str) -> str:
    return f"""{name}_sum AS (SELECT user_id, tag_id, sum(x) AS x FROM {history} JOIN unit USING (item_id) GROUP BY user_id, tag_id),
{name}_len AS (SELECT user_id, sqrt(sum(x * x)) AS l FROM {name}_sum GROUP BY user_id),
{name} AS (SELECT c.user_id, c.item_id, sum(p.x * u.x) / any_value(l) AS s FROM cand c JOIN unit u USING (item_id) JOIN {name}_sum p ON p.user_id = c.user_id AND p.tag_id = u.tag_id JOIN {name}_len n ON n.user_id = c.user_id GROUP BY c.user_id, c.item_id)"""


@query(q(*_CAND, o.RELEVANCE, "unit AS (SELECT item_id, tag_id, relevance / sqrt(sum(relevance * relevance) OVER (PARTITION BY item_id)) AS x FROM relevance)",
    "recent AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r FROM liked) WHERE r <= 10)", _sim("liked", "sa"), _sim("recent", "sr"),
    select="""SELECT user_id, item_id, round(sa.s, 6) AS content_sim_all, round(sr.s, 6) AS content_sim_recent, (item_id IN (SELECT item_id FROM unit))::INT AS has_content
FROM cand LEFT JOIN sa USING (user_id, item_id) LEFT JOIN sr USING (user_id, item_id)"""))
def genome_similarity(spark, d, k=_K):
    data, _, cands = _candidates(spark, d, k)
    out = rk.content_features(cands, _context(data))
    return out.select("user_id", "item_id", F.round("content_sim_all", 6).alias("content_sim_all"), F.round("content_sim_recent", 6).alias("content_sim_recent"), "has_content")


@query(q(*_CAND, "probe AS (SELECT user_id, item_id, cutoff FROM cand JOIN (SELECT user_id, max(ts) AS cutoff FROM train GROUP BY user_id) USING (user_id))", select="""
SELECT p.user_id, p.item_id, round(ln(1 + count(r.ts)), 9) AS pit_item_log_n, round(ln(1 + count(*) FILTER (r.rating >= 4)), 9) AS pit_item_log_pos, avg(r.rating) AS pit_item_mean,
round((any_value(cutoff) - max(r.ts)) / 86400.0::DOUBLE, 9) AS pit_days_since_last, round((any_value(cutoff) - min(r.ts)) / 86400.0::DOUBLE, 9) AS pit_age_days
FROM probe p LEFT JOIN ratings r ON r.item_id = p.item_id AND r.ts < p.cutoff GROUP BY p.user_id, p.item_id"""))
def pit_features(spark, d, k=_K):
    data, _, cands = _candidates(spark, d, k)
    probes = cands.select("user_id", "item_id").join(rk.last_train_ts(data.train()), "user_id")
    out = rk.point_in_time(probes, data.ratings)
    return out.withColumns({c: F.round(c, 9) for c in ("pit_item_log_n", "pit_item_log_pos", "pit_days_since_last", "pit_age_days")})


@query(q(*_CAND, "lab AS (SELECT user_id, item_id, rank, (r.item_id IS NOT NULL)::INT AS label FROM cand LEFT JOIN (SELECT user_id AS u, item_id FROM relevant) r ON r.u = user_id AND r.item_id = cand.item_id)".replace("SELECT user_id, item_id, rank", "SELECT cand.user_id, cand.item_id, rank"),
    select="SELECT user_id, item_id, rank - 1 AS retriever_rank, label FROM (SELECT *, max(label) OVER (PARTITION BY user_id) AS m FROM lab) WHERE m = 1"))
def labelled_rows(spark, d, k=_K):
    _, e, cands = _candidates(spark, d, k)
    return rk.labelled(cands, e.relevant).select("user_id", "item_id", "retriever_rank", "label")


@query(q(*_CAND, f"pred AS (SELECT user_id, item_id, rank, score, {o.H('1', 'user_id', 'item_id')} / 4294967296 AS p FROM cand)",
    select="SELECT user_id, item_id, round(CASE WHEN rank <= 10 THEN p - min(p) FILTER (rank <= 10) OVER (PARTITION BY user_id) + max(score) OVER (PARTITION BY user_id) + 1 ELSE score END, 9) AS score FROM pred"))
def score_adapter(spark, d, k=_K):
    _, _, cands = _candidates(spark, d, k)
    predictions = ev.random_scores(cands.where("retriever_rank < 10"), 1)
    base = cands.select("user_id", "item_id", F.col("retriever_score").alias("score"))
    return rk.adapt_scores(cands, predictions, base).withColumn("score", F.round("score", 9))


def _whole(name: str) -> None:
    """Registers a query's like with the operators' own number of candidates."""
    f, cut, whole = QUERIES[name], *(o.top("pop_scores", k, "cand", "own_seen") for k in (_K, rk.CANDIDATES))
    query(ORACLES[name].replace(cut, whole), f"{name}_whole")(lambda spark, d: f(spark, d, rk.CANDIDATES))


for _name in ("candidates", "rank_features_stats", "genre_overlap", "genome_similarity", "pit_features", "labelled_rows", "score_adapter"):
    _whole(_name)


# ---- statistics, serving, publishing

_TEST = [o.SPLITS, o.evaluation("test"), o.train(), o.POPULAR, "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores"), o.user_metrics()]
_RND = f"ndcg_b AS (SELECT user_id, {o.H('5', 'user_id')} / 4294967296 / 100 AS ndcg FROM metrics)"


def _runs(spark, d):
    """Two runs of per-user figures: popularity, and a hash that stands for another model."""
    _, e, top = _popular(spark, d, "test")
    a = ev.user_metrics(top, e)
    from ..functions import key_hash

    return a, a.select("user_id", (key_hash(5, "user_id") / F.lit(float(1 << 32)) / 100).alias("ndcg"))


@query(q(*_TEST, _BOUNDS, "cls AS (SELECT user_id, CASE WHEN g = 0 THEN 'same_second' WHEN g <= 3600 THEN 'within_1h' ELSE 'over_1h' END AS c FROM (SELECT user_id, test_lo - greatest(train_hi, val_hi) AS g FROM b) WHERE g IS NOT NULL)",
    select="""SELECT coalesce(c, 'all') AS "class", count(*) AS n_users, round(avg(recall), 6) AS mean FROM metrics JOIN cls USING (user_id) GROUP BY GROUPING SETS ((c), ())"""))
def boundary_metrics(spark, d):
    _, e, top = _popular(spark, d, "test")
    return st.breakdown(ev.user_metrics(top, e), st.boundaries(Data(spark, d).splits), "recall")


@query(q(*_TEST, _RND, select="SELECT user_id, round(a.ndcg - b.ndcg, 9) AS diff FROM metrics a JOIN ndcg_b b USING (user_id)"))
def paired_diff(spark, d):
    return st.paired(*_runs(spark, d), "ndcg").withColumn("diff", F.round("diff", 9))


_W = "CASE " + " ".join(f"WHEN u < {e!r} THEN {n}" for n, e in enumerate(st._POISSON)) + f" ELSE {len(st._POISSON)} END"


@query(q(*_TEST, _RND, "diffs AS (SELECT user_id, a.ndcg - b.ndcg AS diff FROM metrics a JOIN ndcg_b b USING (user_id))",
    f"draws AS (SELECT r, diff, {_W} AS w FROM (SELECT r, diff, {o.H('0', 'r', 'user_id')} / 4294967296 AS u FROM diffs, (SELECT unnest(range(1, 201)) AS r)))",
    "reps AS (SELECT r, sum(w * diff) / sum(w) AS m FROM draws GROUP BY r)",
    select="SELECT (SELECT round(avg(diff), 6) FROM diffs) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM reps"))
def poisson_bootstrap_ci(spark, d):
    return st.bootstrap(st.paired(*_runs(spark, d), "ndcg"), n=200)


@query(ORACLES["poisson_bootstrap_ci"].replace("range(1, 201)", f"range(1, {st.REPLICATES + 1})"))
def poisson_bootstrap_ci_whole(spark, d):
    return st.bootstrap(st.paired(*_runs(spark, d), "ndcg"))


_SEEDS = "runs AS (SELECT 'hash' AS model, seed, avg(v) AS value FROM (SELECT seed, " + o.H("seed", "user_id") + " / 4294967296 AS v FROM pop, (SELECT unnest([42, 43, 44]) AS seed)) GROUP BY seed)"


@query(q(o.SPLITS, o.evaluation(), _SEEDS, select="SELECT model, round(quantile_cont(value, 0.5), 9) AS median, round(min(value), 9) AS lowest, round(max(value), 9) AS highest, count(DISTINCT seed) AS n_seeds FROM runs GROUP BY model"))
def seed_summary(spark, d):
    from ..functions import key_hash

    seeds = F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)])).alias("seed")
    runs = Data(spark, d).eval().population.select("user_id", seeds).withColumn("v", key_hash("seed", "user_id") / F.lit(float(1 << 32)))
    runs = runs.groupBy("seed").agg(F.avg("v").alias("value")).withColumn("model", F.lit("hash"))
    return st.seed_summary(runs, "value").withColumns({c: F.round(c, 9) for c in ("median", "lowest", "highest")})


@query("SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right")
def engine_compare(spark, d):
    """Item features by grouping, against the same by SQL."""
    train = Data(spark, d).train()
    train.createOrReplaceTempView("tidemark_train")
    other = spark.sql("SELECT item_id, count(*) AS n_ratings, count_if(rating >= 4) AS n_positives, avg(rating) AS mean_rating, min(ts) AS first_rated_ts, max(ts) AS last_rated_ts FROM tidemark_train GROUP BY item_id")
    return st.same_output(fe.item_features(train), other)


@query(q(o.SPLITS, o.train(), "cat AS (SELECT count(*) AS n FROM liked)", select="SELECT 'kept' AS model, 2 AS seed, 1.5::DOUBLE AS value UNION ALL SELECT 'new', 1, (SELECT n FROM cat)::DOUBLE"))
def replace_model_rows(spark, d):
    old = spark.createDataFrame([("new", 1, 0.5), ("kept", 2, 1.5), ("new", 3, 2.5)], "model string, seed int, value double")
    new = mo.likes(Data(spark, d).train()).agg(F.count("*").cast("double").alias("value")).select(F.lit("new").alias("model"), F.lit(1).alias("seed"), "value")
    return replace_rows(old, new, "model", "new")


@query(q(*_TEST, _RND, select="""SELECT round((SELECT avg(ndcg) FROM ndcg_b), 6) AS candidate, round((SELECT avg(ndcg) FROM metrics), 6) AS live, 0.003::DOUBLE AS margin,
(SELECT avg(ndcg) FROM ndcg_b) > (SELECT avg(ndcg) FROM metrics) + 0.003 AS publish"""))
def publish_gate(spark, d):
    live, candidate = _runs(spark, d)
    return st.publish_gate(candidate, live)


@query(q(*_TEST, _RND, "f AS (SELECT (SELECT avg(ndcg) FROM metrics) AS a, (SELECT avg(ndcg) FROM ndcg_b) AS b)", select="""SELECT 'popular beats hash' AS claim, round(a - b, 6) AS difference, a - b > 0 AS held FROM f
UNION ALL SELECT 'hash beats popular by 0.003', round(b - a, 6), b - a > 0.003 FROM f"""))
def prediction_verdicts(spark, d):
    a, b = _runs(spark, d)
    figures = a.agg(F.avg("ndcg").alias("value")).withColumn("model", F.lit("popular")).unionByName(b.agg(F.avg("ndcg").alias("value")).withColumn("model", F.lit("hash")))
    return st.verdicts(figures, [("popular beats hash", "popular", "hash", 0.0), ("hash beats popular by 0.003", "hash", "popular", 0.003)])


@query(q(o.SPLITS, o.train(), o.POPULAR, "pop AS (SELECT DISTINCT user_id FROM liked)", "seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores"), select="SELECT user_id, item_id, score, rank FROM top"))
def recommend_known(spark, d):
    from .serving import recommend_all

    data = Data(spark, d)
    known = mo.likes(data.train()).select("user_id").distinct()
    return recommend_all(known, data.train(), data.popular())


@query(q(o.SPLITS, o.train(), o.POPULAR, "pop AS (SELECT c_custkey AS user_id FROM customer EXCEPT SELECT user_id FROM liked)", "seen AS (SELECT DISTINCT user_id, item_id FROM train)", "pop_scores AS (SELECT user_id, item_id, score FROM pop CROSS JOIN pop_score)", o.top("pop_scores"), select="SELECT user_id, item_id, rank, 'popular' AS strategy FROM top"))
def recommend_fallback(spark, d):
    from .serving import recommend_all

    data = Data(spark, d)
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    unknown = customers.join(mo.likes(data.train()).select("user_id"), "user_id", "left_anti")
    return recommend_all(unknown, data.train(), data.popular()).select("user_id", "item_id", "rank", F.lit("popular").alias("strategy"))


@query(q(o.SPLITS, o.train(), select="""SELECT user_id, n_ratings, n_positives, coalesce(items, []) AS items FROM (SELECT user_id, count(*) AS n_ratings, count(*) FILTER (rating >= 4) AS n_positives FROM train GROUP BY user_id)
LEFT JOIN (SELECT user_id, list(item_id ORDER BY r) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r FROM liked) WHERE r <= 10 GROUP BY user_id) USING (user_id)"""))
def user_profile(spark, d):
    from .serving import profiles

    return profiles(Data(spark, d).train(), 10)


@query(q(o.RATINGS, f"u AS (SELECT user_id, count(*) AS n, {o.H('0', 'user_id')} AS h FROM ratings GROUP BY user_id)", "c AS (SELECT *, sum(n) OVER (ORDER BY h, user_id) - n AS before FROM u)", select="SELECT user_id, item_id, rating, ts FROM ratings SEMI JOIN (SELECT user_id FROM c WHERE before < 1000) USING (user_id)"))
def benchmark_input(spark, d):
    from .bench import whole_users

    return whole_users(views.ratings(spark, d), 1000)


@query(ORACLES["benchmark_input"].replace("before < 1000", "before < (SELECT count(*) // 5 FROM ratings)"))
def benchmark_input_whole(spark, d):
    """A fifth of the ratings, as 5M are of 25M."""
    from .bench import whole_users

    ratings = views.ratings(spark, d)
    return whole_users(ratings, ratings.count() // 5)


@query()
def two_tower_topk(spark, d):
    from .retriever import TwoTower

    data = Data(spark, d)
    e = data.eval()
    model = TwoTower().fit(written(_pairs(spark, d), "pairs"), seed=42)  # read again and again
    return model.top_k(data.train(), e.population, e.seen).select("user_id", "item_id", "rank")


@query()
def lambdamart_scores(spark, d):
    from .ranker import LambdaMart

    data, e, cands = _candidates(spark, d, rk.CANDIDATES)
    rows = rk.labelled(rk.genre_features(rk.statistics_features(cands, data.train()), data.train(), data.items), e.relevant)
    names = ["retriever_score", "item_log_n", "item_log_pos", "item_mean", "user_log_n", "user_log_pos", "user_mean", "genre_overlap", "genre_max"]
    return LambdaMart(names).fit(rows).transform(rows).select("user_id", "item_id", "score")
