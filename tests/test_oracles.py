"""Every registered query outside llm against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from epochlane.plans.all import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def duck():
    """A database of its own for each test, of bounded memory, so that none can spoil another's."""
    with duckdb.connect(config={"memory_limit": "3GB", "threads": 4}) as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        yield c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(float(v) + 0.0)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Queries without SQL: rows in every column, names once, and values where a share or probability is promised."""
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for c in df.columns:
        # so small a table has too few draws for the shape of a tail
        assert c == "pareto_k" or any(r[c] is not None for r in rows), c
        if c in ("p", "score", "accuracy", "auc", "brier", "p_map", "p_gt", "p_lt1"):
            assert all(r[c] is None or -1e-9 <= r[c] <= 1 + 1e-9 for r in rows), c
