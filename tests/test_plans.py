"""Plans: what reaches the scan, what is a top-k, and that core queries without Python stay in the JVM."""

import re

import pytest

from conftest import SF
from talkweave.plans import CORE_QUERIES

#: The queries whose state or library call needs Python.
PYTHON = {
    "batch_budget", "evidence_window", "rate_limit", "question_filters", "normal_names", "party_labels", "source_audit", "judged_mapping", "terms_held", "issue_timelines",
    "vec_many_filtered", "hybrid_many", "eval_by_axis",
}


def plan(spark, name):
    df = CORE_QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_python_only_where_needed(spark, name):
    assert bool(re.search("InPandas|InArrow|ArrowEval|BatchEval|PythonUDF", plan(spark, name))) == (name in PYTHON)


@pytest.mark.parametrize("name, pushed", [("point_lookup", "In(l_orderkey"), ("kw_search_filtered", "In(lang"), ("profile_recent", "EqualTo(o_orderstatus,F)"), ("pending_antijoin", "StringStartsWith(source,src1)"), ("dim_count_left", "GreaterThan(c_acctbal")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


@pytest.mark.parametrize("name", ["kw_search_documents", "vec_search_topk", "autocomplete", "ops_review", "line_census", "profile_top_mentions", "topic_tally"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["stratified_sample", "my_latest", "candidates_union_cut", "topk_summary"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name, columns", [("profile_totals", 2), ("ops_daily", 2), ("grouping_sets", 3)])
def test_scans_read_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert read and len(read[0].split(",")) == columns


def test_no_cross_joins(spark):
    bad = [n for n in CORE_QUERIES if "CartesianProduct" in plan(spark, n)]
    assert bad == []
