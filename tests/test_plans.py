"""What the plans must not have, and what they must push down."""

import pytest

from pubscope.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_two_tables(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_scans_read_what_is_asked_for(spark, data):
    text = plan(QUERIES["type_counts_rank"](spark, data))
    assert "abstract" not in text and "document_type" in text
    assert "n_chars" not in plan(QUERIES["term_totals"](spark, data))
    assert "lang" not in plan(QUERIES["term_totals"](spark, data))  # every document counts


def test_rankings_with_a_limit_are_top_k(spark, data):
    assert "TakeOrderedAndProject" in plan(QUERIES["suggestions"](spark, data))


def test_counts_combine_before_the_shuffle(spark, data):
    assert "partial_count" in plan(QUERIES["series_order"](spark, data))
