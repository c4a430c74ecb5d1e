"""The physical plans are the ones meant."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from broadsheet.operators.features import replicate, with_features
from broadsheet.plans.base import articles


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def run_plan(df) -> str:
    """The final plan after the adaptive re-planning."""
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def queries():
    return entry_points.queries()


def test_features_stay_in_the_jvm(spark, small, queries):
    text = plan(queries["features"](spark, small))
    assert "Python" not in text and "Exchange" not in text and "ArrowEval" not in text


def test_replicated_features_scan_once(spark, small):
    text = plan(with_features(replicate(articles(spark, small))))
    assert text.count("FileScan") == 1 and "CollectLimit" not in text and "Exchange" not in text


def test_scans_read_only_needed_columns(spark, small, queries):
    assert "ReadSchema: struct<text:string>" in plan(queries["word_frequency"](spark, small))
    by_label = plan(queries["by_label"](spark, small))
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,0)]" in by_label


def test_word_counts_are_partial_before_the_shuffle(spark, small, queries):
    text = plan(queries["word_frequency"](spark, small))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert "TakeOrderedAndProject" in text


def test_class_limit_is_applied_before_the_shuffle(spark, small, queries):
    text = run_plan(queries["top_words_per_class"](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["sentiment", "encoded", "tfidf"])
def test_vocabulary_joins_are_broadcast(spark, small, queries, name):
    text = plan(queries[name](spark, small))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_no_text_is_shuffled_for_terms(spark, small, queries):
    """Exchanges of the TF-IDF query carry keys, terms and numbers."""
    tree = queries["tfidf"](spark, small)._jdf.queryExecution().executedPlan().toString()
    for line in tree.splitlines():
        if "Exchange" in line:
            assert "text#" not in line and "words#" not in line and "terms#" not in line


def test_lemmas_are_found_within_the_row(spark, small, queries):
    text = plan(queries["lemmatized"](spark, small))
    assert "Join" not in text and "Exchange" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize("name", ["sample_n", "head_fraction", "stratified_split", "box_stats", "roc_curve"])
def test_no_unpartitioned_sort_and_no_cross_join(spark, small, queries, name):
    text = plan(queries[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "CollectLimit" not in text and "GlobalLimit" not in text
