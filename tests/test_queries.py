"""Every query of the engine against its SQL, as multisets of rows."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as entry
from goldrec.plans.oracles import ORACLE_SQL
from goldrec.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLE_SQL:
        ran = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in ran.description]
        want = ran.fetchall()
        assert sorted(names) == sorted(got.columns)
        order = [names.index(c) for c in got.columns]
        a = collections.Counter(tuple(map(plain, r)) for r in rows)
        b = collections.Counter(tuple(plain(r[k]) for k in order) for r in want)
        assert not (a - b) and not (b - a), (list((a - b).items())[:3], list((b - a).items())[:3])


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "entity_key"
