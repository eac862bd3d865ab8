"""Join remedies against plain joins, null keys, and sink properties."""

import pytest
from pyspark.sql import functions as F

from sparkwright.operators.joins import band_join, bounded_rows, broadcast_join, fits_broadcast, salted_join
from sparkwright.operators.skew import key_skew_profile
from sparkwright.plans.run import run_job
from sparkwright.session import fresh_location, fresh_table_name
from sparkwright.sources.tables import parquet_dir_resolver

from conftest import SF_SMALL

R = parquet_dir_resolver(SF_SMALL)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, repr(x)) for x in t))


@pytest.fixture(scope="module")
def li(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")


@pytest.fixture(scope="module")
def part(spark):
    return spark.read.parquet(f"{SF_SMALL}/part.parquet")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [None, 0.01])
def test_salted_equals_plain(li, part, how, hot):
    p = part.filter("p_size > 20")  # misses make left/anti meaningful
    plain = li.join(p, li.l_partkey == p.p_partkey, how)
    salted = salted_join(li, p, ["l_partkey"], ["p_partkey"], how, salts=5,
                         salt_from=["l_orderkey", "l_linenumber"], hot_fraction=hot)
    assert _rows(salted) == _rows(plain)


def test_salted_refuses_outer_right(li, part):
    with pytest.raises(ValueError):
        salted_join(li, part, ["l_partkey"], ["p_partkey"], "right")


def test_salted_hot_key_skew(spark):
    # one key holds half of the rows; the result still equals the plain join
    left = spark.range(0, 4000).select((F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 50))
                                       .alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 50).select(F.col("id").alias("k2"), (F.col("id") * 10).alias("w"))
    plain = left.join(right, left.k == right.k2)
    salted = salted_join(left, right, ["k"], ["k2"], "inner", salts=16, salt_from=["v"], hot_fraction=0.05)
    assert _rows(salted) == _rows(plain)


def test_band_join_equals_nested_loop(spark):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet").filter("p_size > 30")
    s = spark.read.parquet(f"{SF_SMALL}/supplier.parquet")
    cond = "__br.s_acctbal BETWEEN __bl.p_retailprice AND __bl.p_retailprice + 250"
    banded = band_join(p, s, cond, "__bl.p_retailprice", "__bl.p_retailprice + 250", "__br.s_acctbal", 100)
    plain = p.alias("a").join(s.alias("b"), F.expr("b.s_acctbal BETWEEN a.p_retailprice AND a.p_retailprice + 250"))
    assert _rows(banded) == _rows(plain)


def test_broadcast_only_when_bounded(spark, part):
    assert bounded_rows(part, 10) is None
    assert bounded_rows(part, 10_000) == part.count()
    assert fits_broadcast(part, max_rows=10_000)
    assert not fits_broadcast(part, max_rows=10_000, max_bytes=100)
    from sparkwright.operators.joins import measure
    n, b = measure(part)
    names = part.agg(F.sum(F.octet_length("p_name") + F.octet_length("p_brand") + F.octet_length("p_type"))).first()[0]
    assert n == part.count() and b == n * (8 + 8 + 4 + 8) + names  # header + key + size + price
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    hinted = broadcast_join(o, c, "o_custkey = c_custkey", "inner", max_rows=10_000)
    refused = broadcast_join(o, c, "o_custkey = c_custkey", "inner", max_rows=10)
    assert _rows(hinted) == _rows(refused)


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c"), (None, "d")], "k2 int, y string")
    from sparkwright.operators.joins import join
    assert join(a, b, "k = k2", "inner").count() == 1
    assert join(a, b, "k <=> k2", "inner").count() == 2
    assert join(a, b, "k = k2", "full").count() == 3


def test_key_skew_profile(li):
    r = key_skew_profile(li, ["l_suppkey"], "lineitem").first()
    n = li.count()
    top = li.groupBy("l_suppkey").count().agg(F.max("count")).first()[0]
    assert (r.n_rows, r.max_freq) == (n, top) and 1 <= r.skew <= 10


def _target_spec(table, path, mode, status="F", **extra):
    t = {"table": table, "path": path, "mode": mode}
    t.update(extra)
    return {"tables": [{"name": "orders", "alias": "o", "predicate": f"o_orderstatus = '{status}'"}], "target": t}


def test_overwrite_twice_is_once_and_append_twice_doubles(spark):
    n = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderstatus = 'F'").count()
    name, path = fresh_table_name("t_over"), fresh_location(spark, "t_over")
    run_job(spark, _target_spec(name, path, "overwrite"), resolver=R)
    assert run_job(spark, _target_spec(name, path, "overwrite"), resolver=R).count() == n
    name2, path2 = fresh_table_name("t_app"), fresh_location(spark, "t_app")
    run_job(spark, _target_spec(name2, path2, "append"), resolver=R)
    assert run_job(spark, _target_spec(name2, path2, "append"), resolver=R).count() == 2 * n


def test_static_partitions_are_strings(spark):
    name, path = fresh_table_name("t_part"), fresh_location(spark, "t_part")
    out = run_job(spark, _target_spec(name, path, "overwrite", partitions=[{"column": "batch", "value": "07"}]),
                  resolver=R)
    assert dict(out.dtypes)["batch"] == "string" and {r.batch for r in out.select("batch").collect()} == {"07"}


def test_replace_only_written_partition(spark):
    name, path = fresh_table_name("t_repl"), fresh_location(spark, "t_repl")
    spec = {"tables": [{"name": "orders", "alias": "o"}],
            "target": {"table": name, "path": path, "mode": "overwrite",
                       "partitions": [{"column": "o_orderstatus", "value": None}]}}
    full = run_job(spark, spec, resolver=R)
    before = {r.o_orderstatus: r["count"] for r in full.groupBy("o_orderstatus").count().collect()}
    repl = {"tables": [{"name": "orders", "alias": "o", "predicate": "o_orderstatus = 'F' AND o_totalprice > 200000"}],
            "transformations": [{"kind": "select", "output_column": c, "expression": c} for c in
                                ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")],
            "target": {"table": name, "mode": "overwrite", "replace_partitions": True,
                       "partitions": [{"column": "o_orderstatus", "value": "F"}]}}
    after = {r.o_orderstatus: r["count"] for r in run_job(spark, repl, resolver=R)
             .groupBy("o_orderstatus").count().collect()}
    assert after["O"] == before["O"] and after["P"] == before["P"] and after["F"] < before["F"]
    # and the session setting is restored
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_insert_with_column_list_fills_unlisted_with_null(spark):
    from sparkwright.sources.sinks import create_table
    name = fresh_table_name("t_cols")
    create_table(spark, name, "a BIGINT, b DOUBLE, note STRING", path=fresh_location(spark, "t_cols"))
    spec = {"tables": [{"name": "orders", "alias": "o"}],
            "transformations": [{"output_column": "x", "expression": "o_totalprice"},
                                {"output_column": "y", "expression": "o_orderkey"}],
            "target": {"table": name, "mode": "append", "columns": ["b", "a"]}}
    out = run_job(spark, spec, resolver=R)
    r = out.orderBy("a").first()
    assert r.note is None and r.a == 0 and r.b is not None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_right_skewed_salted_join_equals_plain(spark, how):
    from sparkwright.operators.joins import Chain
    # right side: key 3 holds half of all rows; left side has keys with and without partners
    right = spark.range(0, 3000).select(F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id") % 40)
                                        .alias("rk"), F.col("id").alias("rv"))
    left = spark.range(0, 60).select((F.col("id") % 50).alias("lk"), F.col("id").alias("lv"))
    chain = Chain.of(left.alias("a"), "a").join_salted(right, "b", None, how, ["a.lk"], ["rk"], salts=6,
                                                         salt_from=["b.rv"], hot_fraction=0.05, skewed_side="right")
    plain = left.join(right, left.lk == right.rk, how)
    assert _rows(chain.flattened().df) == _rows(plain)


def test_right_skewed_left_join_with_extra_condition(spark):
    from sparkwright.operators.joins import Chain
    # right key 3 holds half the rows; the condition leaves some hot-key left rows without any partner,
    # and the left side has duplicate rows
    right = spark.range(0, 3000).select(F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id") % 40)
                                        .alias("rk"), F.col("id").alias("rv"))
    left = spark.range(0, 80).select((F.col("id") % 50).alias("lk"), (F.col("id") % 7 * 500).alias("lim"))
    # two identical hot-key rows that no right row can satisfy
    left = left.unionByName(spark.createDataFrame([(3, 0), (3, 0)], "lk long, lim long"))
    cond = "b.rv < a.lim"
    got = Chain.of(left.alias("a"), "a").join_salted(right, "b", cond, "left", ["a.lk"], ["rk"], salts=6,
                                                      salt_from=["b.rv"], hot_fraction=0.05, skewed_side="right")
    plain = left.alias("a").join(right.alias("b"), F.expr("a.lk = b.rk AND b.rv < a.lim"), "left")
    assert _rows(got.df) == _rows(plain)
    assert got.df.filter("rk IS NULL AND lk = 3").count() == 2  # hot-key rows without partners survive


def test_target_schema_is_created(spark):
    name = fresh_table_name("t_db")
    spec = _target_spec(name, fresh_location(spark, "t_db"), "overwrite")
    spec["target"]["schema"] = "sales_dw_test"
    out = run_job(spark, spec, resolver=R)
    assert out.count() > 0 and spark.catalog.tableExists(f"sales_dw_test.{name}")


@pytest.mark.parametrize("how", ["right", "full"])
@pytest.mark.parametrize("hot", [None, 0.05])
@pytest.mark.parametrize("side", ["left", "right"])
def test_salted_outer_join_equals_plain(spark, how, hot, side):
    from sparkwright.operators.joins import salted_outer_join
    # key 3 holds half of the left rows; both sides have keys without partners, and null keys
    left = spark.range(0, 2000).select(
        F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit(3))
        .otherwise(F.col("id") % 30).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 60).select(F.when(F.col("id") == 59, F.lit(None)).otherwise(F.col("id") % 45)
                                      .alias("k"), (F.col("id") * 10).alias("w"))
    if side == "right":  # make the right side the hot one
        left, right = right.withColumnRenamed("w", "v"), left.withColumnRenamed("v", "w")
    if hot is None and side == "right":
        hot = 0.05  # the right-hot form always salts only the hot keys
    plain = left.join(right, left.k == right.k, how)
    salted = salted_outer_join(left, right, ["k"], ["k"], how, salts=5,
                               salt_from=["v"] if side == "left" else ["w"], hot_fraction=hot, skewed_side=side)
    assert salted.columns == plain.columns
    assert _rows(salted) == _rows(plain)


def test_dynamic_partition_write_writes_few_files(spark):
    import glob
    name, path = fresh_table_name("t_files"), fresh_location(spark, "t_files")
    spec = {"tables": [{"name": "lineitem", "alias": "l"}],
            "target": {"table": name, "path": path, "mode": "overwrite",
                       "partitions": [{"column": "l_returnflag", "value": None}]}}
    out = run_job(spark, spec, resolver=R)
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    files = glob.glob(f"{path}/l_returnflag=*/*.parquet")
    # one file per flag value here (the data is small), not one per task and value
    assert len(files) == len({r.l_returnflag for r in out.select("l_returnflag").distinct().collect()})


def test_join_advice(spark):
    from sparkwright.operators.skew import join_advice
    small = spark.range(0, 50).select(F.col("id").alias("k2"))
    big_hot = spark.range(0, 5000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id"))
                                          .alias("k2"), F.col("id").alias("v"))
    left = spark.range(0, 200).select(F.col("id").alias("k"))
    assert join_advice(left, small, ["k"], ["k2"], "left")["strategy"] == "broadcast"
    a = join_advice(left, big_hot, ["k"], ["k2"], "left", max_broadcast_rows=100)
    assert a["strategy"] == "salted" and a["salt"]["skewed_side"] == "right"
    assert join_advice(left, big_hot, ["k"], ["k2"], "inner", max_broadcast_rows=100) == {}
    assert join_advice(big_hot.withColumnRenamed("k2", "k"), left.withColumnRenamed("k", "k2"), ["k"], ["k2"],
                       "full")["strategy"] == "salted"


def test_band_join_auto_width(spark):
    df = run_job(spark, {
        "tables": [{"name": "part", "alias": "p", "predicate": "p_size > 30"}, {"name": "supplier", "alias": "s"}],
        "joins": [{"type": "inner", "right_table": "s", "strategy": "band",
                   "conditions": "s.s_acctbal BETWEEN p.p_retailprice AND p.p_retailprice + 250",
                   "band": {"low": "p.p_retailprice", "high": "p.p_retailprice + 250", "point": "s.s_acctbal",
                            "width": "auto"}}]}, resolver=R)
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet").filter("p_size > 30")
    s = spark.read.parquet(f"{SF_SMALL}/supplier.parquet")
    want = p.alias("x").join(s.alias("y"), F.expr("y.s_acctbal BETWEEN x.p_retailprice AND x.p_retailprice + 250"))
    assert _rows(df) == _rows(want)


def test_static_partition_never_replaces_a_column(spark):
    from sparkwright.sources.sinks import with_static_partitions

    df = spark.createDataFrame([(1, "F"), (2, "O")], "k int, status string")
    with pytest.raises(ValueError, match="already a column"):
        with_static_partitions(df, [("Status", "F")])
    assert with_static_partitions(df, [("batch", "7")], {"batch": "int"}).dtypes[-1] == ("batch", "int")


def test_append_to_a_typed_partition(spark):
    from sparkwright.sources.sinks import Target, create_table, write

    create_table(spark, "typed_part", "k INT, batch INT", partitioned_by=["batch"])
    write(spark.createDataFrame([(1,), (2,)], "k int"), Target(table="typed_part", mode="append", partitions=[("batch", "7")]))
    assert sorted(map(tuple, spark.read.table("typed_part").collect())) == [(1, 7), (2, 7)]
    spark.sql("DROP TABLE typed_part")


def test_subquery_text_with_literal_braces(spark):
    from sparkwright.sources.tables import subquery

    df = spark.createDataFrame([("ab",), ("a",)], "v string")
    assert [r.v for r in subquery(spark, "SELECT v FROM {t} WHERE v RLIKE '^.{2}$'", {"t": df}).collect()] == ["ab"]


@pytest.mark.parametrize("hot", [None, 0.01])
def test_salted_sides_are_never_broadcast(spark, hot):
    # each right row is there eight times, so a side that looks small must not pass the driver
    left = spark.createDataFrame([(i % 3, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (None, "d")], "k2 long, w string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 << 20))
    try:
        salted = salted_join(left, right, ["k"], ["k2"], "inner", salts=8, salt_from=["v"], hot_fraction=hot)
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == (0 if hot is None else 2)  # two: the bounded list of hot keys
        assert _rows(salted) == _rows(left.join(right, left.k == right.k2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
