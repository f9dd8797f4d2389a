"""Every query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from foliant.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(catalogue.ORACLE_SQL[name])
        assert got == rows([d[0] for d in found.description], found.fetchall())
    else:
        assert got[1]
