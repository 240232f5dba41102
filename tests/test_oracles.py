"""Every query with SQL gives the rows that DuckDB gives; every other one runs and has stable columns."""

import datetime
import decimal
import math

import duckdb
import pytest

from quayside.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() > 0 and df.columns == catalog.queries()[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_card_plan_of_all_orders(spark, sf):
    own = catalog.queries()["card_installment_plan"](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert own.count() == 6 * orders.count() and own.select("o_orderkey").distinct().count() == orders.count()


def test_contamination_by_short_items(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [(f"i{n}", " ".join(words[:n])) for n in range(1, 11)] + [("part", "ta gam"), ("none", "nowhere at all here"), ("null", None)]
    docs = [(n, f"before xx{' '.join(words[:n])}yy after") for n in range(1, 11)] + [(20, "alpha"), (21, ""), (22, None), (23, "al pha")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["contamination_join"](spark, str(tmp_path)).collect()))
    assert got == sorted((k, i) for k, t in docs for i, x in items if t is not None and x is not None and x in t)
