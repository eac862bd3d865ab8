"""Property checks on random inputs: each example set is one small Spark job."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.functions import jobs as J
from sparkwright.operators.joins import band_join, salted_join

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

token = st.one_of(
    st.integers(-999, 9999).map(str),
    st.floats(-1e4, 1e4, allow_nan=False).map(lambda x: f"{x:.3f}"),
    st.sampled_from(["", " ", "1e2", ".5", "-3.", "+7", "x", "1_000", "10d", "inf", "nan", "1 2", "--1"]),
)
texts = st.lists(st.lists(token, max_size=6).map(lambda items: " , ".join(items)), min_size=20, max_size=40)


def python_rule(text):
    items = [x.strip() for x in text.split(",") if x.strip()]
    if any(not re.fullmatch(J.NUMBER, x) for x in items):
        return [1.0]
    return [float(x) for x in items]


@SETTINGS
@given(texts)
def test_list_parser_matches_rule(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", J.parse_number_list(F.col("t")).alias("a")).collect()}
    for i, t in enumerate(batch):
        assert got[i] == python_rule(t), t


rows = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1000)), min_size=1, max_size=120)


@SETTINGS
@given(rows, st.lists(st.tuples(st.integers(0, 8), st.integers(0, 50)), min_size=0, max_size=30),
       st.sampled_from(["inner", "left", "left_semi", "left_anti"]), st.integers(1, 7),
       st.sampled_from([None, 0.2]))
def test_salted_join_equals_plain_join(spark, left_rows, right_rows, how, salts, hot):
    # key 0 is made hot on purpose
    left = spark.createDataFrame([(0 if v % 3 == 0 else k, v) for k, v in left_rows], "k int, v int")
    right = spark.createDataFrame(right_rows, "k2 int, w int")
    plain = left.join(right, left.k == right.k2, how)
    salted = salted_join(left, right, ["k"], ["k2"], how, salts=salts, salt_from=["v"], hot_fraction=hot)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 120)), min_size=1, max_size=60),
       st.lists(st.integers(-50, 700), min_size=1, max_size=60), st.sampled_from([7, 25, 100]))
def test_band_join_equals_condition_join(spark, ranges, points, width):
    a = spark.createDataFrame([(i, lo, lo + ln) for i, (lo, ln) in enumerate(ranges)], "i int, lo int, hi int")
    b = spark.createDataFrame([(j, p) for j, p in enumerate(points)], "j int, p int")
    cond = "__br.p BETWEEN __bl.lo AND __bl.hi"
    got = band_join(a, b, cond, "__bl.lo", "__bl.hi", "__br.p", width)
    want = a.alias("x").join(b.alias("y"), F.expr("y.p BETWEEN x.lo AND x.hi"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@SETTINGS
@given(rows, st.lists(st.tuples(st.integers(0, 8), st.integers(0, 50)), min_size=0, max_size=30),
       st.sampled_from(["right", "full"]), st.sampled_from(["left", "right"]), st.integers(1, 6))
def test_salted_outer_join_equals_plain_join(spark, left_rows, right_rows, how, side, salts):
    from sparkwright.operators.joins import salted_outer_join
    left = spark.createDataFrame([(0 if v % 3 == 0 else k, v) for k, v in left_rows], "k int, v int")
    right = spark.createDataFrame(right_rows, "k2 int, w int")
    plain = left.join(right, left.k == right.k2, how)
    got = salted_outer_join(left, right, ["k"], ["k2"], how, salts=salts,
                            salt_from=["v"] if side == "left" else ["w"], hot_fraction=0.2, skewed_side=side)
    key = lambda t: tuple((x is None, repr(x)) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 60)), min_size=1, max_size=60),
       st.lists(st.tuples(st.integers(0, 6), st.integers(0, 60)), min_size=0, max_size=120), st.integers(1, 5))
def test_right_skewed_left_join_with_condition_equals_plain(spark, left_rows, right_rows, salts):
    from sparkwright.operators.joins import Chain
    left = spark.createDataFrame(left_rows, "lk int, lim int")
    # key 0 made hot on the right
    right = spark.createDataFrame([(0 if w % 2 == 0 else k, w) for k, w in right_rows], "rk int, rv int")
    got = Chain.of(left.alias("a"), "a").join_salted(right, "b", "b.rv < a.lim", "left", ["a.lk"], ["rk"],
                                                      salts=salts, salt_from=["b.rv"], hot_fraction=0.2,
                                                      skewed_side="right").df
    plain = left.alias("a").join(right.alias("b"), F.expr("a.lk = b.rk AND b.rv < a.lim"), "left")
    key = lambda t: tuple((x is None, repr(x)) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
