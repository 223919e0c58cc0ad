"""The driver's contract, and each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = entry.core.queries()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def same(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    q = duck.execute(entry.oracle_sql()[name])
    found = [d[0] for d in q.description]
    assert sorted(found) == names
    order = [found.index(c) for c in names]
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) & set(entry.core.oracle_sql())))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(spark, duck, sf, name)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.core.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_engine_info_and_measures(spark):
    from deltaforge import measure
    from deltaforge.session import engine_info

    assert engine_info(spark)["spark.sql.session.timeZone"] == "UTC"
    t = measure.int8_apply(spark, 1000, 1)
    assert t.per_second > 0 and set(measure.extrapolated(t)) == set(measure.SIZES)
    assert measure.long_or_blocks(spark, 1000, 100).speedup > 0
    stream, both = measure.stream_benchmark(spark, 2, 100)
    assert stream.elements == 200 and stream.megabytes_per_second > 0 and both.speedup > 0
    assert not measure.rebuilt(spark, "/none", "/none", "/none").success
