"""SQL that states its query's rule for larger tables too, in small cases."""

from functools import partial

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cachelake import catalog, catalog_banks
from cachelake.operators import trees as tr
from cachelake.operators import windows as wn
from cachelake.plans import jobs as jb

GIVEN = catalog.GIVEN


def against(spark, frame, con, sql):
    columns = sorted(frame.columns)
    got = sorted(map(str, (tuple(r) for r in frame.select(columns).collect())))
    rows = con.execute(f"select {', '.join(f'x.\"{c}\"' for c in columns)} from ({sql}) x").fetchall()
    assert got and got == sorted(map(str, rows))


def test_trees_of_more_than_three_digits(spark):
    con = duckdb.connect()
    con.execute("create table pairs as select 'g' \"group\", concat('p', i) path, concat('h', i % 7) hash from range(5000) r(i) union all select 'few', 'p', concat(i) from range(3) r(i)")
    rows = spark.createDataFrame(con.execute("select * from pairs").fetchall(), "group string, path string, hash string")
    tree = tr.hash_tree(rows, 4)
    assert tree.agg({"depth": "max"}).first()[0] == 4
    against(spark, tree, con, f"with {catalog_banks._tree_sql('select * from pairs', 'select grp as \"group\", depth, prefix, n, digest from tree', 4)}")


def test_canonical_keys_of_a_root_with_over_a_leaf_of_files(spark, tmp_path):
    n = 1100
    pq.write_table(pa.table({"doc_id": [50 * i + 1 for i in range(n)], "text": [f"t{i}" for i in range(n)], "lang": ["en"] * n, "source": ["src1"] * n, "n_chars": [2] * n}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    against(spark, catalog.QUERIES["canonical_keys"](spark, str(tmp_path)), con, catalog.SQL["canonical_keys"])


def test_banks_with_longer_prefixes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jb, "prefix_length_of", partial(wn.prefix_length_of, most=16))
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    name = "publish_all_of_small_prefixes"
    catalog.query(name, catalog._all_sql(16))(lambda t: jb.publish_all(catalog._published(t), catalog._row_publish(t)))
    sql, query = catalog.SQL.pop(name), catalog.QUERIES.pop(name)
    against(spark, query(spark, sf_dir), con, sql)
