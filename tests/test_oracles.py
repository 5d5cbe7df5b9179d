"""Every query of the core library against DuckDB on the smallest tables."""

import duckdb
import pytest

from cachelake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalog.SQL[name])
    expected = table([c[0] for c in cursor.description], cursor.fetchall())
    assert table(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    counts = {r["verdict"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert set(counts) <= {"HIT", "MISS", "UNSERVABLE"} and sum(counts.values()) == 1500


def test_negative_ttl_with_keys_over_several_batches(spark, duck, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        test_query_equals_sql(spark, duck, sf_dir, "negative_ttl")
    finally:
        spark.conf.set(name, before)
