"""Every registered query with SQL gives the same rows as that SQL."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points

SQL = entry_points.oracle_sql()
SLOW = {
    "vectorized", "logistic_scores", "boosted_scores", "cross_validation", "cross_validation_summary",
    "saved_model_scores", "classifier_report", "scored_stream", "fitted_comparison", "boosted_cross_validation",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    assert differences(spark, con, name, entry_points.queries()[name], SQL[name], small) is None


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.count() == 200
    assert len(df.columns) == 18


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
    without = {n for n in set(entry_points.queries()) - set(SQL) if not n.startswith("op")} - {"pipeline"}
    assert without <= SLOW | {"page_articles"}


@pytest.mark.parametrize("name", ["page_articles", "logistic_scores", "saved_model_scores", "classifier_report", "cross_validation", "scored_stream"])
def test_queries_without_sql_run(spark, small, name):
    assert entry_points.queries()[name](spark, small).count() > 0
