"""Spec validation and transformation routing: one test per reference decision."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwright.operators.transforms import Transformation, apply_transformations, classify, split_top_level
from sparkwright.plans.run import build_frame, run_job
from sparkwright.plans.spec import parse_spec
from sparkwright.sources.tables import parquet_dir_resolver

from conftest import SF_SMALL

R = parquet_dir_resolver(SF_SMALL)


def _t(expr, out="x", kind=None):
    return Transformation(out, expr, kind)


def test_classify_word_boundaries():
    # checksum( is not an aggregate, "sum (" is; windows are their own role
    assert classify(_t("checksum(a)")) == "select"
    assert classify(_t("sum (a)")) == "agg"
    assert classify(_t("COUNT(DISTINCT a)")) == "agg"
    assert classify(_t("Group By a, b")) == "group"
    assert classify(_t("sum(a) over (partition by b)")) == "window"
    assert classify(_t("a + 1", kind="column")) == "column"


def test_split_top_level_keeps_function_commas():
    # Keys are parsed at top level and keep their case
    assert split_top_level("coalesce(a, b), C, substr(d, 1, 2)") == ["coalesce(a, b)", "C", "substr(d, 1, 2)"]


def test_aggregates_alias_not_keyword(spark):
    # Aggregates become expr(..).alias(name)
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    out = apply_transformations(df, [_t("group by c_mktsegment", ""), _t("count(*)", "n")])
    assert out.columns == ["c_mktsegment", "n"]


def test_keys_without_aggregates_are_distinct(spark):
    # D3
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    out = apply_transformations(df, [_t("group by c_mktsegment", "")])
    assert out.count() == df.select("c_mktsegment").distinct().count()


def test_aggregates_only_is_global_agg(spark):
    # D5
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    out = apply_transformations(df, [_t("count(*)", "n"), _t("max(l_quantity)", "mx")])
    assert out.count() == 1 and out.first().n == df.count()


def test_window_alone_adds_column(spark):
    # A lone aggregate window keeps every input column
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    out = apply_transformations(df, [_t("sum(o_totalprice) over (partition by o_custkey)", "cust_total")])
    assert out.columns == df.columns + ["cust_total"] and out.count() == df.count()


def test_mixing_select_and_aggregates_is_an_error(spark):
    # D6
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    with pytest.raises(ValueError, match="o_orderkey"):
        apply_transformations(df, [_t("group by o_custkey", ""), _t("o_orderkey", "o_orderkey")])


def test_lateral_alias(spark):
    # F4
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    out = apply_transformations(df, [_t("o_totalprice * 2", "a"), _t("a + 1", "b")])
    r = out.first()
    assert r.b == r.a + 1


def test_blank_table_row_dropped_and_alias_used():
    # D16, D8
    js = parse_spec({"tables": [{"name": "", "alias": ""}, {"name": "orders", "alias": "o"}]})
    assert [t.alias for t in js.tables] == ["o"]


def test_self_join_needs_aliases():
    # D17
    with pytest.raises(ValueError, match="left_alias"):
        parse_spec({"tables": [{"name": "supplier", "alias": "s"}], "joins": [{"type": "self", "conditions": "x"}]})


def test_left_table_must_be_in_chain():
    # D26
    with pytest.raises(ValueError, match="left_table"):
        parse_spec({"tables": [{"name": "a", "alias": "a"}, {"name": "b", "alias": "b"}],
                    "joins": [{"type": "inner", "left_table": "zz", "right_table": "b", "conditions": "a.x=b.x"}]})


def test_partition_lists_must_match():
    # D14
    with pytest.raises(ValueError, match="partition"):
        parse_spec({"tables": [{"name": "a"}], "output_table": "t", "partition_columns": "a,b",
                    "partition_values": "1"})


def test_saved_job_json_text_form():
    spec = {"tables": json.dumps([{"name": "orders", "alias": "o", "schema": "s", "predicate": ""}]),
            "joins": "[]", "predicates": "", "transformations": "[]", "output_table": "t", "output_schema": "s",
            "write_mode": "append", "partition_columns": "", "partition_values": ""}
    js = parse_spec(spec)
    assert js.target.qualified == "s.t" and js.target.mode == "append" and js.target.partitions == []


def test_duplicate_columns_flattened(spark):
    # Both sides' key columns survive under distinct names
    df = build_frame(spark, {"tables": [{"name": "supplier", "alias": "a"}, {"name": "supplier", "alias": "b"}],
                             "joins": [{"type": "inner", "right_table": "b",
                                        "conditions": "a.s_suppkey = b.s_suppkey"}]}, resolver=R)
    assert len(df.columns) == len(set(df.columns)) == 8
    assert "b_s_suppkey" in df.columns


def test_self_join_after_chain(spark):
    # The chain is flattened, then both new aliases address the flattened names
    df = build_frame(spark, {
        "tables": [{"name": "supplier", "alias": "s"}, {"name": "nation", "alias": "n"}],
        "joins": [{"type": "inner", "right_table": "n", "conditions": "s.s_nationkey = n.n_nationkey"},
                  {"type": "self", "left_alias": "x", "right_alias": "y",
                   "conditions": "x.n_regionkey = y.n_regionkey AND y.s_suppkey = x.s_suppkey + 1"}],
        "transformations": [{"output_column": "a", "expression": "x.s_suppkey"},
                            {"output_column": "b", "expression": "y.s_suppkey"}]}, resolver=R)
    s = spark.read.parquet(f"{SF_SMALL}/supplier.parquet")
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    sn = s.join(n, s.s_nationkey == n.n_nationkey)
    expect = sn.alias("x").join(sn.alias("y"),
                                F.expr("x.n_regionkey = y.n_regionkey AND y.s_suppkey = x.s_suppkey + 1"))
    assert df.count() == expect.count()


def test_spec_equals_hand_written_dataframe(spark):
    spec = {"tables": [{"name": "customer", "alias": "c", "predicate": "c_acctbal > 0"},
                       {"name": "orders", "alias": "o"}],
            "joins": [{"type": "left", "right_table": "o", "conditions": "c.c_custkey = o.o_custkey"}],
            "predicates": "c.c_mktsegment <> 'HOUSEHOLD'",
            "transformations": [{"output_column": "", "expression": "group by c.c_mktsegment"},
                                {"output_column": "n", "expression": "count(o.o_orderkey)"}]}
    got = sorted(tuple(r) for r in run_job(spark, spec, resolver=R).collect())
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").filter("c_acctbal > 0")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    want = (c.join(o, c.c_custkey == o.o_custkey, "left").filter(c.c_mktsegment != "HOUSEHOLD")
             .groupBy("c_mktsegment").agg(F.count(o.o_orderkey).alias("n")))
    assert got == sorted(tuple(r) for r in want.collect())


def test_settings_applied(spark):
    from sparkwright.functions.conf import apply_settings, parse_settings
    text = "spark.sql.shuffle.partitions = 13\nnot a setting\n  spark.executor.memory = 4g"
    assert parse_settings(text) == [("spark.sql.shuffle.partitions", "13"), ("spark.executor.memory", "4g")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = apply_settings(spark, text)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "13"
        assert res == {"applied": ["spark.sql.shuffle.partitions"], "skipped": ["spark.executor.memory"]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_spec_preview_and_settings(spark):
    old = spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    try:
        df = run_job(spark, {"tables": [{"name": "orders", "alias": "o"}], "preview": 7,
                             "settings": ["spark.sql.adaptive.skewJoin.skewedPartitionFactor = 9"]}, resolver=R)
        assert df.count() == 7
        assert spark.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionFactor") == "9"
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", old)


def test_subquery_reads_filtered_frame_and_catalog(spark):
    # {o} binds the filtered alias frame; a bare name would go to the catalog
    df = build_frame(spark, {
        "tables": [{"name": "customer", "alias": "c"},
                   {"name": "orders", "alias": "o", "predicate": "o_orderstatus = 'F'"}],
        "joins": [{"type": "subquery", "right_alias": "q", "conditions": "c.c_custkey = q.k",
                   "subquery": "SELECT o_custkey AS k, count(*) AS n FROM {o} GROUP BY o_custkey"}],
        "transformations": [{"output_column": "", "expression": "count(*)"}]}, resolver=R)
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderstatus = 'F'")
    assert df.first()[0] == o.select("o_custkey").distinct().count()


def test_table_predicate_may_use_alias(spark):
    a = build_frame(spark, {"tables": [{"name": "orders", "alias": "o", "predicate": "o.o_totalprice > 300000"}]},
                    resolver=R)
    b = build_frame(spark, {"tables": [{"name": "orders", "alias": "o", "predicate": "o_totalprice > 300000"}]},
                    resolver=R)
    assert a.count() == b.count() > 0


def test_saved_job_file_end_to_end(spark):
    """The form's saved-job shape: JSON-text lists, catalog tables by schema.name, '==' conditions, a
    flat target with comma-text partitions, run as it is."""
    import uuid
    db = f"dw_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    for t in ("orders", "customer"):
        spark.sql(f"CREATE TABLE {db}.{t} USING parquet LOCATION '{SF_SMALL}/{t}.parquet'")
    saved = {
        "tables": json.dumps([{"name": "orders", "schema": db, "alias": "o", "predicate": "o_totalprice > 100000"},
                              {"name": "customer", "schema": db, "alias": "c", "predicate": ""}]),
        "joins": json.dumps([{"left_table": "o", "type": "inner", "right_table": "c",
                              "conditions": "o.o_custkey == c.c_custkey"}]),
        "predicates": "c.c_acctbal > 0",
        "transformations": json.dumps([{"output_column": "", "expression": "group by c.c_mktsegment"},
                                       {"output_column": "n_orders", "expression": "count(*)"}]),
        "output_table": "seg_orders", "output_schema": db, "write_mode": "overwrite",
        "partition_columns": "", "partition_values": ""}
    out = run_job(spark, saved)
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_totalprice > 100000")
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").filter("c_acctbal > 0")
    want = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert spark.catalog.tableExists(f"{db}.seg_orders")


@pytest.mark.parametrize("how", ["right", "full"])
def test_salted_outer_step_in_a_chain(spark, how):
    spec = {"tables": [{"name": "customer", "alias": "c", "predicate": "c_acctbal > 8000"},
                       {"name": "orders", "alias": "o", "predicate": "o_totalprice > 100000"},
                       {"name": "nation", "alias": "n"}],
            "joins": [{"type": how, "right_table": "o", "strategy": "salted",
                       "salt": {"left_keys": ["c.c_custkey"], "right_keys": ["o.o_custkey"], "salts": 4,
                                "salt_from": ["c.c_name"],
                                "hot_fraction": 0.01}},
                      {"type": "left", "right_table": "n", "conditions": "c_nationkey = n.n_nationkey"}],
            "transformations": [{"output_column": "", "expression": "group by n_name"},
                                {"output_column": "n_orders", "expression": "count(o_orderkey)"},
                                {"output_column": "n_rows", "expression": "count(*)"}]}
    got = sorted(map(tuple, run_job(spark, spec, resolver=R).collect()), key=repr)
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").filter("c_acctbal > 8000")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_totalprice > 100000")
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    j = c.join(o, c.c_custkey == o.o_custkey, how)
    want = (j.join(n, j.c_nationkey == n.n_nationkey, "left").groupBy("n_name")
             .agg(F.count("o_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n_rows")))
    assert got == sorted(map(tuple, want.collect()), key=repr)


def test_strategy_not_silently_ignored():
    with pytest.raises(ValueError, match="subquery"):
        parse_spec({"tables": [{"name": "a"}], "joins": [{"type": "subquery", "subquery": "SELECT 1 AS x",
                                                          "conditions": "true", "strategy": "salted",
                                                          "salt": {"left_keys": ["a"], "right_keys": ["x"]}}]})
    with pytest.raises(ValueError, match="self"):
        parse_spec({"tables": [{"name": "a"}], "joins": [{"type": "self", "left_alias": "l", "right_alias": "r",
                                                          "conditions": "true", "strategy": "broadcast"}]})
