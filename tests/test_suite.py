"""Every query of the suite against its SQL on the smallest tables."""

import duckdb
import pytest

from quillframe.plans.suite import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def test_expression_queries_run_no_python(spark):
    for name in ("csv_roundtrip_orders", "validate_errors_by_rule", "multi_schema_route", "jsonl_paths", "fixed_width_read", "injection_escape"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_merge_duplicates_over_whole_tables(spark):
    from itertools import groupby

    from quillframe.operators import render

    def brute(pairs):
        runs = [(v, [k for k, _ in g]) for v, g in groupby(sorted(pairs), key=lambda x: x[1])]
        return sorted(((v, g[0], g[-1]) for v, g in runs if len(g) > 1), key=str)

    pairs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderstatus").collect()]
    got = [tuple(r) for r in QUERIES["merge_duplicates"](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got, key=str) == brute(pairs) and max(r[2] for r in got) > 2000
    # runs over several ranges, of nulls too
    pairs = [(k, v) for k, v in enumerate([None] * 50 + ["a"] * 120 + ["b", None, None, "b"] * 5 + ["a"])]
    df = spark.createDataFrame(pairs, "at bigint, v string")
    for parts in (1, 3, 64):
        assert sorted((tuple(r) for r in render.merge_duplicates(df, "v", "at", parts).collect()), key=str) == brute(pairs)
    assert render.merge_duplicates(df.limit(0), "v", "at").collect() == []


@pytest.mark.parametrize("second", ["second", None])
def test_xlsx_sanitize_takes_rows_by_key(spark, tmp_path, second):
    """Keys in no order, on both sides of the SQL's border, names that are empty or null: the rows are those of the SQL."""
    rows = [(2_000_000, "far"), (1_048_576, "next"), (1_048_575, "last"), (0, "first"), (1, second), (2, ""), (3, "a & <b>")]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["xlsx_sanitize"](spark, str(tmp_path)).select("p_partkey", "name").collect())
    assert got == sorted(db.sql(ORACLES["xlsx_sanitize"]).select("p_partkey, name").fetchall()) and len(got) == 5
