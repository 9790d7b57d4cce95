"""Every registered query of the grid engine against its DuckDB oracle."""

import os

import duckdb
import pytest

from slotwise.plans import catalog_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def rows_of(pdf):
    names = sorted(pdf.columns)
    return names, sorted(str([None if v != v else v for v in r]) for r in pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist())


@pytest.mark.parametrize("name", list(catalog_queries.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = catalog_queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert rows_of(found) == rows_of(duck.sql(catalog_queries.ORACLES[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Only the needed columns are read, and a summary of writes dealt by block
    needs one exchange."""
    from slotwise.operators import blocks, ingest
    from slotwise.plans.fixtures import SLOTS

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan(catalog_queries.QUERIES["valid_samples"](spark, SF_DIR))
    rows = spark.createDataFrame([(1, 0, 0, 1.0, 192, 1, 0)], "series_id long, block_id long, slot int, value double, quality int, tx long, pos int")
    assert plan(blocks.summaries(ingest.last_writes(rows, by_block=True), SLOTS)).count("Exchange hashpartitioning") == 1
