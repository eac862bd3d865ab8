"""RANGE frames with hot keys split, and windows cut by whole ordering tuples, equal the plain windows."""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwright.operators.lattice import Measure
from sparkwright.operators.range_frames import range_window
from sparkwright.operators.windows import WinOut, skew_safe_window


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        k = "hot" if i % 2 else rng.choice(["a", "b", "c", None])
        v = None if i % 41 == 0 else round(rng.choice([rng.random() * 100, float(rng.randrange(10))]), 2)
        data.append((i, k, v, rng.randrange(40), start + dt.timedelta(minutes=rng.randrange(5000)), rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "id long, k string, v double, n int, ts timestamp_ntz, x int")


MEASURES = [Measure("c", "count"), Measure("cx", "count", "x"), Measure("s", "sum", "x"), Measure("lo", "min", "id"), Measure("hi", "max", "id"), Measure("m", "avg", "x")]


@pytest.mark.parametrize("order, preceding, following", [
    ("v", "3.5", "0.25"), ("n", "2", None), ("n", None, "5"), ("ts", "INTERVAL 90 MINUTES", "INTERVAL 10 MINUTES"), ("CAST(v AS DECIMAL(9,2))", "60", "60"), ("v", None, None)])
@pytest.mark.parametrize("buckets", [2, 7])
def test_equals_plain_frame(rows, order, preceding, following, buckets):
    got = range_window(rows, ["k"], order, MEASURES, preceding, following, hot_fraction=0.1, buckets=buckets)
    frame = (f"(PARTITION BY k ORDER BY {order} RANGE BETWEEN {preceding + ' PRECEDING' if preceding else 'CURRENT ROW'} "
             f"AND {following + ' FOLLOWING' if following else 'CURRENT ROW'})")
    want = rows.selectExpr("*", f"count(*) OVER {frame} AS c", f"count(x) OVER {frame} AS cx", f"sum(x) OVER {frame} AS s", f"min(id) OVER {frame} AS lo",
                           f"max(id) OVER {frame} AS hi", f"avg(x) OVER {frame} AS m")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_null_key_may_be_hot_and_all_values_equal(spark):
    df = spark.createDataFrame([(i, None, 5 if i % 3 else None) for i in range(200)], "id long, k string, v int")
    got = range_window(df, ["k"], "v", [Measure("c", "count"), Measure("hi", "max", "id")], "1", "1", hot_fraction=0.1)
    want = df.selectExpr(
        "*", "count(*) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c",
        "max(id) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_whole_table_and_empty_input(rows):
    got = range_window(rows, [], "n", MEASURES[:2], "1", None, hot_fraction=0.1, buckets=5)
    want = rows.selectExpr("*", "count(*) OVER (ORDER BY n RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS c",
                           "count(x) OVER (ORDER BY n RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS cx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert range_window(rows.where("false"), ["k"], "n", MEASURES, "1").collect() == []


def test_window_partitions_hold_one_bucket(rows):
    # the hot key's window runs by key and bucket, and its copies are those near a border
    got = range_window(rows.where("k = 'hot' AND v IS NOT NULL"), ["k"], "CAST(v AS DECIMAL(9,2))", MEASURES[:1], "0.5", "0.5", hot_fraction=0.1, buckets=8)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain()
    assert "windowspecdefinition(k" in buf.getvalue() and "__b" in buf.getvalue()


def test_unknown_functions_and_names_are_refused(rows):
    with pytest.raises(ValueError, match="no range frame"):
        range_window(rows, ["k"], "n", [Measure("q", "quantile", "x")], "1")
    with pytest.raises(ValueError, match="already"):
        range_window(rows, ["k"], "n", [Measure("x", "count")], "1")


OUTS = [WinOut("row_number", "rn"), WinOut("lag", "lg", "id"), WinOut("lead", "ld", "id"), WinOut("lag", "lg3", "id", offset=3), WinOut("lead", "ld2", "id", offset=2),
        WinOut("running_sum", "rs", "CAST(id AS DECIMAL(18,0))"), WinOut("rows_sum", "r4", "CAST(id AS DECIMAL(18,0))", preceding=4)]


@pytest.mark.parametrize("order", [
    [("z", True), ("n", False), ("v", True), ("id", True)],       # a constant first column, mixed directions, nulls
    [("t", False), ("v", False), ("id", True)],                   # text first
    [("nothing", True), ("ts", True), ("id", False)],             # null in every row
    [("x", True), ("id", False)],                                 # few values first
])
def test_tuples_split_what_the_first_column_cannot(rows, order):
    df = rows.withColumn("z", F.lit(1)).withColumn("t", F.concat(F.lit("t"), F.col("n") % 3)).withColumn("nothing", F.lit(None).cast("int"))
    got = skew_safe_window(df, ["k"], order, OUTS, hot_fraction=0.1, buckets=6)
    w = Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order])
    money = F.col("id").cast("decimal(18,0)")
    want = df.select("*", F.row_number().over(w).alias("rn"), F.lag("id").over(w).alias("lg"), F.lead("id").over(w).alias("ld"), F.lag("id", 3).over(w).alias("lg3"),
                     F.lead("id", 2).over(w).alias("ld2"), F.sum(money).over(w).alias("rs"), F.sum(money).over(w.rowsBetween(-4, 0)).alias("r4"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_ranks_keep_peers_together(rows):
    df = rows.withColumn("z", F.lit("same"))
    order = [("z", True), ("n", False)]
    got = skew_safe_window(df, ["k"], order, [WinOut("rank", "r"), WinOut("dense_rank", "d")], hot_fraction=0.1, buckets=6)
    w = Window.partitionBy("k").orderBy("z", F.col("n").desc())
    want = df.select("*", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
