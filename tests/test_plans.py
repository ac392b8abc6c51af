"""Physical-plan checks over every registered query (on the smoke data)."""

import re

import pytest

from tensio.plans.catalog import QUERIES

from conftest import SF001

SKIP = {"classify_posts", "classifier_report"}


def executed_plan(df):
    df.collect()  # run so that adaptive plans are final
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]  # the final plan only


@pytest.fixture(scope="module")
def plans(spark):
    return {n: executed_plan(fn(spark, SF001)) for n, fn in QUERIES.items() if n not in SKIP}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert not bad


def test_regex_chain_once_per_cleaning(plans):
    for name in ("clean_dataset", "relevant_posts_demo", "terms_found", "term_counts", "min_length_filter"):
        assert plans[name].count("translate(lower(") == 1, name


def test_scans_read_only_needed_columns(plans):
    def schemas(p):
        return re.findall(r"ReadSchema: (struct<[^>]*>)", p) or re.findall(r"struct<[^>]*>", p)

    assert all("props" not in s for s in schemas(plans["sentinel_replace"]))
    assert all("c_acctbal" not in s for s in schemas(plans["label_map"]))
    assert all("text" not in s for s in schemas(plans["drop_null_label"]))


def test_python_only_arrow_batched_and_only_where_documented(plans):
    assert not [n for n, p in plans.items() if "BatchEvalPython" in p]
    with_python = {n for n, p in plans.items() if "ArrowEvalPython" in p}
    assert with_python <= {"token_sequences", "padded_sequences"}, with_python
