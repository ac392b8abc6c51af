"""Filtering queries keep some rows and drop some on the test tables (sf0.01)."""

import pytest

import __spark_entry__ as E
from tensio.sources.tables import read_table

from conftest import SF01

# query -> (input table, whether the output is a strict subset of it)
FILTERS = {
    "clean_dataset": "documents",
    "relevant_posts_demo": "documents",
    "dedupe_raw": "documents",
    "min_length_filter": "documents",
    "drop_null_label": "documents",
    "seeded_sample": "documents",
    "prepare_corpus": None,
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filter_keeps_some_and_drops_some(spark, name):
    out = E.queries()[name](spark, SF01).count()
    table = FILTERS[name]
    total = read_table(spark, SF01, table).count() if table else 1576  # three post tables
    assert 0 < out < total, (name, out, total)


def test_negative_exports_are_a_proper_subset(spark):
    rec = E.queries()["prediction_record"](spark, SF01).count()
    neg = E.queries()["negative_predictions"](spark, SF01).count()
    assert 0 < neg < rec


def test_topic_shares_sum_to_100(spark):
    for name in ("topic_share", "topic_share_demo"):
        rows = E.queries()[name](spark, SF01).collect()
        assert abs(sum(r["pct"] for r in rows) - 100.0) < 1e-9 and sum(r["hits"] for r in rows) > 0
