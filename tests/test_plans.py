"""Plans: columns and filters reach the scan, and nothing is joined by comparing all rows."""

import re

import pytest

from leafstack import registry


def plan(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("digests", "doc_id text"), ("glob_filter", "page_id url"), ("event_runs", "event_id user_id event_type"), ("lookup_id", "c_custkey c_nationkey"), ("total_size_known", "doc_id source n_chars"), ("snap_one", "l_orderkey l_linenumber l_discount"), ("bytes_human", "o_orderkey o_totalprice")])
def test_columns(spark, sf_dir, name, columns):
    first = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, sf_dir, name))[1]
    assert {c.split(":")[0] for c in first.split(",")} == set(columns.split())


@pytest.mark.parametrize(("name", "what"), [("date_after", "GreaterThan(o_orderdate"), ("child_activities", "GreaterThan(value,50.0)")])
def test_filters(spark, sf_dir, name, what):
    assert what in re.search(r"PushedFilters: \[([^\]]*)\]", plan(spark, sf_dir, name))[1]


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_no_cross_joins(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, sf_dir, name))


@pytest.mark.parametrize("name", ["find_next", "nav_next", "nav_next_wrap", "nav_folder_next", "nav_after_removal"])
def test_no_frames_that_shrink(spark, sf_dir, name):
    """A frame from near the row to the end of its tree is read again for every row."""
    assert not re.search(r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan(spark, sf_dir, name))
