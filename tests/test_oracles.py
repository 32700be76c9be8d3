"""Every query of the catalogue against its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tokenloom.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{FOLDER}/{t}.parquet").exists():
            db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return db


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.4f}"
        return v

    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert bag(got.collect(), got.columns) == bag(want.fetchall(), names)
