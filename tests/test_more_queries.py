import math

import duckdb
import pytest

from tidemark.plans import more_queries
from tidemark.plans.queries import ORACLES, QUERIES

NAMES = [n for n, f in QUERIES.items() if f.__code__.co_filename == more_queries.__file__ and n in ORACLES]
TABLES = ("lineitem", "orders", "part", "events", "embeddings", "customer", "nation")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, db, name):
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want and want
