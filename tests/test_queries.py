"""Every registered query against its SQL definition, and the shape of its plan."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from workload.catalog import QUERIES
from workload.fixtures import BASE_TABLES, table

FOLDER = "/root/testdata/sf0.001"
# Grouped Python only where rows depend on the ones before.
PYTHON = {"dedupe_results", "rate_limit"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_definition(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    result = db.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = canonical(result.fetchall(), names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == expected
    assert expected

    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)
    assert ("InPandas" in plan) == (name in PYTHON)


def test_flagship(spark):
    rows = entry_points.entry(spark).collect()
    prices = [r.price for r in rows if r.price is not None]
    assert prices and prices == sorted(prices) and all(r.distance_km <= 100 for r in rows)


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry_points.queries()["first_links"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_only_needed_columns_are_read(spark):
    plan = entry_points.queries()["api_rows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    (schema,) = set(re.findall(r"ReadSchema: (\S+)", plan))
    assert "l_shipdate" not in schema and "l_partkey" in schema


def test_filters_reach_the_scan(spark, tmp_path):
    from offerloom.operators.results import filter_results

    path = str(tmp_path / "results")
    table(spark, FOLDER, "fx_results").write.parquet(path)
    plan = filter_results(spark.read.parquet(path), price_min=5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(price", plan)
