"""Every registered query against its SQL."""

import pytest
from conftest import rows_of

from chromaflow.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["color_histogram"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    assert "BatchScan" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_nearest_needs_no_shuffle(spark, sf):
    from chromaflow.functions import color as C
    from chromaflow.operators import nearest
    from chromaflow.plans.registry import palette_np
    from chromaflow.sources import bindings as B
    from pyspark.sql import functions as F

    c = B.line_colors(spark, sf).select(C.color_key(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    near = c.select(nearest.nearest_rgb(nearest.palette_array(palette_np()), *C.channels(F.col("rgb"))).alias("i"))
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
