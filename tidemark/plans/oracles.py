"""DuckDB SQL for the registered queries, put together from shared common table expressions."""

from __future__ import annotations

H = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"

RATINGS = """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, ceil(l_quantity / 5) / 2 AS rating, epoch(o_orderdate)::BIGINT AS ts,
  row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ratings AS (SELECT user_id, item_id, rating, ts FROM raw WHERE rn = 1)"""

SPLITS = f"""{RATINGS},
cuts AS (SELECT floor(quantile_cont(ts, 0.8))::BIGINT AS t80, floor(quantile_cont(ts, 0.9))::BIGINT AS t90 FROM ratings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
ends AS (SELECT *, CASE WHEN n < 10 THEN n ELSE n * 8 // 10 END AS e1, CASE WHEN n < 10 THEN n ELSE n * 9 // 10 END AS e2 FROM ranked),
splits AS (SELECT user_id, item_id, rating, ts,
  CASE WHEN i <= e1 THEN 'train' WHEN i <= e2 THEN 'val' ELSE 'test' END AS split_user,
  CASE WHEN i <= e1 * 7 // 8 THEN 'core' WHEN i <= e1 THEN 'tail' END AS train_part,
  CASE WHEN ts <= t80 THEN 'train' WHEN ts <= t90 THEN 'val' ELSE 'test' END AS split_global,
  CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split_random
  FROM (SELECT *, ({H("42", "user_id", "item_id")} % 1000000) / 1000000 AS u FROM ends), cuts)"""

ITEMS = """items AS (SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_size = 50 THEN '(no genres listed)' ELSE replace(p_name, ' ', '|') END AS genres FROM part),
item_genres AS (SELECT DISTINCT item_id, unnest(string_split(genres, '|')) AS genre FROM items WHERE genres <> '(no genres listed)')"""

RELEVANCE = """relevance AS (SELECT vec_id AS item_id, (unnest(range(1, len(embedding) + 1)) - 1)::BIGINT AS tag_id, unnest(embedding)::DOUBLE AS relevance FROM embeddings)"""

TRAINING = {"train_core": "train_part = 'core'", "train": "split_user = 'train'", "train_val": "split_user IN ('train', 'val')"}


def train(name: str = "train") -> str:
    return f"train AS (SELECT * FROM splits WHERE {TRAINING[name]}),\nliked AS (SELECT user_id, item_id, ts FROM train WHERE rating >= 4)"


def evaluation(target: str = "val", scheme: str = "user") -> str:
    s = f"split_{scheme}"
    earlier = "('train')" if target == "val" else "('train', 'val')"
    return f"""pop AS (SELECT user_id FROM splits WHERE {s} = 'train' AND rating >= 4 INTERSECT SELECT user_id FROM splits WHERE {s} = '{target}' AND rating >= 4),
seen AS (SELECT user_id, item_id FROM splits SEMI JOIN pop USING (user_id) WHERE {s} IN {earlier}),
relevant AS (SELECT user_id, item_id FROM splits SEMI JOIN pop USING (user_id) WHERE {s} = '{target}' AND rating >= 4),
ever AS (SELECT user_id, item_id FROM splits SEMI JOIN pop USING (user_id)),
pool AS (SELECT DISTINCT item_id FROM splits WHERE {s} IN {earlier})"""


def negatives(n: int, seed: int = 20260922) -> str:
    return f"""place AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM pool),
size AS (SELECT count(*) AS n FROM pool),
prime AS (SELECT min(p) AS prime FROM (SELECT unnest(range(greatest(n, 2), n + 500)) AS p FROM size)
  WHERE p NOT IN (SELECT p FROM (SELECT unnest(range(greatest(n, 2), n + 500)) AS p FROM size), (SELECT unnest(range(2, 1500)) AS d) WHERE d * d <= p AND p % d = 0)),
walker AS (SELECT user_id, least(prime, {n} + prime - n + rated) AS steps, {H(str(seed), "user_id", "'a'")} % prime AS a, 1 + {H(str(seed), "user_id", "'b'")} % greatest(1, prime - 1) AS b, prime
  FROM (SELECT user_id, count(*) AS rated FROM ever GROUP BY user_id), prime, size),
walk AS (SELECT user_id, j, (a + b * j) % prime AS place FROM (SELECT *, unnest(range(steps)) AS j FROM walker)),
drawn AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS r
  FROM walk JOIN place USING (place) ANTI JOIN ever USING (user_id, item_id)) WHERE r <= {n})"""


POPULAR = """pop_score AS (SELECT i.item_id, count(l.user_id)::DOUBLE AS score FROM (SELECT p_partkey AS item_id FROM part) i LEFT JOIN liked l USING (item_id) GROUP BY 1)"""


def top(scores: str, k: int = 10, name: str = "top", seen: str = "seen") -> str:
    """The k best unseen of a frame of scores."""
    return f"""{name} AS (SELECT user_id, item_id, score, rank FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM {scores} ANTI JOIN {seen} USING (user_id, item_id)) WHERE rank <= {k})"""


def user_metrics(k: int = 10) -> str:
    return f"""hits AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM top JOIN relevant USING (user_id, item_id) GROUP BY user_id),
metrics AS (SELECT user_id, n AS n_relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / least(n, {k}) AS recall,
  coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda r: 1 / log2(r + 1))) AS ndcg
  FROM (SELECT user_id, count(*) AS n FROM relevant GROUP BY user_id) LEFT JOIN hits USING (user_id))"""


def auc(scores: str) -> str:
    s = lambda t: f"SELECT t.user_id, coalesce(s.score, '-infinity'::DOUBLE) AS v FROM {t} t LEFT JOIN {scores} s USING (user_id, item_id)"
    return f"""aucs AS (SELECT p.user_id, avg(CASE WHEN p.v > q.v THEN 1.0 WHEN p.v = q.v THEN 0.5 ELSE 0 END::DOUBLE) AS auc
  FROM ({s("relevant")}) p JOIN ({s("drawn")}) q ON p.user_id = q.user_id GROUP BY p.user_id)"""


def gram(min_positives: int) -> str:
    return f"""kept AS (SELECT item_id, count(*) AS n FROM liked GROUP BY item_id HAVING count(*) >= {min_positives}),
own AS (SELECT user_id, item_id FROM liked SEMI JOIN kept USING (item_id)),
gram AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n FROM own a JOIN own b USING (user_id) GROUP BY 1, 2)"""


def knn(k: int, shrink: float) -> str:
    return f"""sim AS (SELECT i, j, s FROM (SELECT g.i, g.j, g.n / (sqrt(x.n::DOUBLE) * sqrt(y.n::DOUBLE) + {shrink}) AS s,
    row_number() OVER (PARTITION BY g.j ORDER BY g.n / (sqrt(x.n::DOUBLE) * sqrt(y.n::DOUBLE) + {shrink}) DESC, g.i) AS r
  FROM gram g JOIN kept x ON g.i = x.item_id JOIN kept y ON g.j = y.item_id WHERE g.i <> g.j) WHERE r <= {k}),
knn_score AS (SELECT u.user_id, k.item_id, round(coalesce(s, 0), 9) AS score
  FROM pop u CROSS JOIN kept k LEFT JOIN (SELECT l.user_id, sim.j AS item_id, sum(s) AS s FROM liked l JOIN sim ON l.item_id = sim.i GROUP BY 1, 2) x ON x.user_id = u.user_id AND x.item_id = k.item_id)"""


def q(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
