"""The physical-plan properties the scale design relies on, as regression tests.

Plans are read through the public ``explain()`` with automatic broadcast and AQE off, the shape a plan
takes when no table is small enough to broadcast by estimate (see PLANS.md).
"""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


@pytest.fixture()
def at_scale(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(spark, name, mode="simple"):
    df = E.queries()[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def count(text, op):
    return len(re.findall(rf"(?<![A-Za-z]){re.escape(op)}", text))


def test_predicates_reach_the_scan(at_scale):
    p = plan(at_scale, "scan_filter", "formatted")
    assert "GreaterThan(l_quantity,45.0)" in p and "Not(EqualTo(l_returnflag,N))" in p


def test_global_predicate_moves_below_the_joins(at_scale):
    p = plan(at_scale, "join_chain", "formatted")
    assert "EqualTo(c_mktsegment,BUILDING)" in p and "GreaterThan(o_totalprice,100000.0)" in p


def test_columns_are_pruned(at_scale):
    p = plan(at_scale, "inner_join", "formatted")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all(s.count(":") <= 3 for s in schemas)


def test_fact_load_shuffles_the_fact_twice(at_scale):
    p = plan(at_scale, "fact_sales")
    # orders x customer, x lineitem (order key), x part (part key); dates and sales reps broadcast
    assert count(p, "SortMergeJoin") == 3 and count(p, "BroadcastHashJoin") == 2
    lineitem_scans = [l for l in p.splitlines() if "FileScan" in l and "lineitem" in l]
    assert len(lineitem_scans) == 1


def test_fleet_pipeline_has_three_shuffles(at_scale):
    p = plan(at_scale, "job_features")
    assert count(p, "Exchange hashpartitioning") == 3 and count(p, "SortMergeJoin") == 2


def test_skew_profile_scans_once(at_scale):
    p = plan(at_scale, "key_skew_profile")
    assert count(p, "FileScan") == 1 and count(p, "Expand") == 1


@pytest.mark.parametrize("name", ["theta_join", "salted_join", "salted_left_join", "join_chain_hot",
                                  "salted_full_join", "self_join"])
def test_no_all_pairs_plans(at_scale, name):
    p = plan(at_scale, name)
    assert count(p, "CartesianProduct") == 0 and count(p, "BroadcastNestedLoopJoin") == 0


def test_cross_join_only_over_a_broadcast_side(at_scale):
    p = plan(at_scale, "cross_join")
    assert count(p, "CartesianProduct") == 0 and count(p, "BroadcastNestedLoopJoin") == 1


def test_no_python_in_any_plan(at_scale):
    # the text operators choose their style one by one; tests/llm holds those that promise native functions
    for name in E.queries():
        if name.startswith("write_") or name in ("fact_sales_load", "pipeline") or re.match(r"op\d+_", name):
            continue
        p = plan(at_scale, name)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


@pytest.mark.parametrize("name", ["window_rank_hot", "window_frame_hot", "window_analytics"])
def test_hot_windows_split_by_bucket(at_scale, name):
    p = plan(at_scale, name)
    # the window is partitioned by (key, bucket), so a hot key is several tasks
    assert re.search(r"Window \[.*\], \[[a-z_]+#\d+L?, __b#\d+\]", p), p[:2000]
