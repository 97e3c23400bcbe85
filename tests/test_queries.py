"""Every query of the library against its SQL, on the smallest data set."""

import math
import os

import duckdb
import pytest

from quarry.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(value, v)) + "]" if isinstance(v, list) else str(v)


def rows(cols, data):
    return sorted("|".join(value(r[cols.index(c)]) for c in sorted(cols)) for r in data)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE_SQL and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, got) == rows(cols, r.fetchall())


def test_loop_detector_stream_equals_batch(spark):
    stream, batch = (sorted(map(tuple, QUERIES[n](spark, SF_DIR).collect())) for n in ("x1_loop_detector", "x1_loop_detector_batch"))
    assert stream == batch
