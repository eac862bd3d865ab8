"""Grid and overlap joins equal the nested loop, without one in the plan."""

import contextlib
import io
import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from sparkwright import run_job
from sparkwright.operators import theta
from sparkwright.operators.theta import grid_join, overlap_join

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def explained(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def points():
    rng = random.Random(8)

    def side(n):
        # a third of the rows alike, ties, nulls, columns that depend on each other
        out = []
        for i in range(n):
            x = 50 if i % 3 == 0 else rng.choice([None, rng.randrange(100), rng.randrange(10)])
            y = 50.0 if i % 3 == 0 else rng.choice([None, rng.random() * 100, float(x or 0) + rng.random()])
            out.append((i, x, y))
        return out

    return side(260), side(190)


@pytest.mark.parametrize("one, two", [("<", ">"), ("<=", "<="), (">=", "<"), (">", None)])
@pytest.mark.parametrize("bands, target", [(4, 100_000), (3, 20), (1, 7)])
def test_grid_equals_nested_loop(spark, points, one, two, bands, target):
    a, b = points
    left, right = spark.createDataFrame(a, "id long, x int, y double").alias("a"), spark.createDataFrame(b, "id long, x int, y double").alias("b")
    bounds = [("a.x", one, "b.x"), ("a.y + 30", two, "b.y")][: 2 if two else 1]
    got = grid_join(left, right, bounds, "a.id % 5 <> b.id % 5", bands, target)
    want = []
    for p, q in itertools.product(a, b):
        if p[1] is None or q[1] is None or not OPS[one](p[1], q[1]) or p[0] % 5 == q[0] % 5:
            continue
        if two and (p[2] is None or q[2] is None or not OPS[two](p[2] + 30, q[2])):
            continue
        want.append((p[0], q[0]))
    assert sorted(map(tuple, got.select("a.id", "b.id").collect())) == sorted(want)
    p = explained(got)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_grid_handles_not_a_number_and_empty_sides(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, nan), (2, inf), (3, 1.0), (4, None)], "id int, x double").alias("a")
    right = spark.createDataFrame([(5, nan), (6, inf), (7, 0.0)], "id int, x double").alias("b")
    for op in OPS:
        want = left.crossJoin(right).where(f"a.x {op} b.x").select("a.id", "b.id")
        got = grid_join(left, right, [("a.x", op, "b.x")], None, 3).select("a.id", "b.id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert grid_join(left.where("false"), right, [("a.x", "<", "b.x")]).collect() == []


@pytest.fixture()
def shuffled(spark):
    """No broadcast and no merging of small partitions, as at scale."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_cells_are_bounded_however_alike_the_rows_are(shuffled):
    spark = shuffled
    left = spark.range(3000).selectExpr("id", "1 AS x", "2 AS y").alias("a")
    right = spark.range(40).selectExpr("id", "id AS x", "3 AS y").alias("b")
    got = grid_join(left, right, [("a.x", ">", "b.x"), ("a.y", "<", "b.y")], None, 4, 100)
    assert got.count() == 3000  # b.x = 0 alone
    # 3,000 equal rows are dealt to 30 parts of about 100 rows
    sizes = [len(x) for x in got.rdd.glom().collect()]
    assert max(sizes) < 1500


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(9)

    def side(n):
        out = []
        for i in range(n):
            low = rng.randrange(-300, 300) if i % 3 else 10
            length = rng.choice([0, 1, 2, 5, 5, 5, 40, 3000, -1])
            out.append((i, None if i % 37 == 0 else low, None if i % 41 == 0 else low + length, i % 4))
        return out

    return side(230), side(210)


@pytest.mark.parametrize("width", [None, 0.5, 7.0, 10_000.0])
@pytest.mark.parametrize("keyed", [False, True])
def test_overlap_gives_every_pair_once(spark, spans, width, keyed):
    a, b = spans
    schema = "id long, lo int, hi int, k int"
    left, right = spark.createDataFrame(a, schema).alias("a"), spark.createDataFrame(b, schema).alias("b")
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), [("a.k", "b.k")] if keyed else None, "a.id <> b.id", width)
    want = [(p[0], q[0]) for p, q in itertools.product(a, b)
            if None not in (*p, *q) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2] and p[0] != q[0] and (not keyed or p[3] == q[3])]
    assert sorted(map(tuple, got.select("a.id", "b.id").collect())) == sorted(want)
    p = explained(got)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_long_spans_have_few_copies(spark):
    # one span over a million units among a thousand of one unit
    left = spark.range(1000).selectExpr("id", "id * 1000 AS lo", "id * 1000 + 1 AS hi").alias("a")
    right = spark.createDataFrame([(1, 0, 1_000_000)], "id int, lo int, hi int").alias("b")
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=2.0)
    assert got.count() == 1000
    sent = overlap_join(right, left, ("b.lo", "b.hi"), ("a.lo", "a.hi"), width=2.0)
    assert sent.count() == 1000


@pytest.mark.parametrize("target", [3, 20, 100_000])
def test_dealt_buckets_give_every_pair_once(spark, spans, target):
    a, b = spans
    a, b = a + a[:60], b + b[50:90]  # repeated rows stay apart
    schema = "id long, lo int, hi int, k int"
    left, right = spark.createDataFrame(a, schema).alias("a"), spark.createDataFrame(b, schema).alias("b")
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=50.0, target_rows=target)
    want = [(p[0], q[0]) for p, q in itertools.product(a, b)
            if None not in (*p, *q) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2]]
    assert sorted(map(tuple, got.select("a.id", "b.id").collect())) == sorted(want)


def test_rows_of_one_bucket_are_dealt_to_tasks(spark):
    left = spark.range(2000).selectExpr("id", "0 AS lo", "1 AS hi").alias("a")
    right = spark.range(300).selectExpr("id", "0 AS lo", "2 AS hi").alias("b")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=4.0, target_rows=50)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 600_000 and len(sizes) == 8 and max(sizes) < 200_000


def test_spec_errors_and_empty_sides(spark, spans):
    left = spark.createDataFrame(spans[0], "id long, lo int, hi int, k int")
    tables = [{"name": "t", "alias": "a"}, {"name": "t", "alias": "b"}]

    def job(**join):
        return run_job(spark, {"tables": tables, "joins": [{"right_table": "b", **join}]}, resolver=lambda *a, **k: left)

    with pytest.raises(ValueError, match="theta"):
        job(type="inner", strategy="grid")
    with pytest.raises(ValueError, match="only exact as an inner join"):
        job(type="left", strategy="overlap", theta={"left": ["a.lo", "a.hi"], "right": ["b.lo", "b.hi"]})
    with pytest.raises(ValueError, match="takes"):
        grid_join(left.alias("a"), left.alias("b"), [("a.lo", "=", "b.lo")])
    none = left.where("false")
    assert overlap_join(none.alias("a"), left.alias("b"), ("a.lo", "a.hi"), ("b.lo", "b.hi")).collect() == []


def test_pairs_follow_one_another_in_the_order_of_their_spans(spark):
    # 30 left spans and 40 right ones of a few lengths, mixed; a cell's rows come by their spans, so that few runs are made
    left = spark.createDataFrame([(i, i % 3, i % 3 + 1) for i in range(30)], "id long, lo int, hi int").alias("a").repartition(4)
    right = spark.createDataFrame([(i, i % 4, i % 4) for i in range(40)], "id long, lo int, hi int").alias("b").repartition(4)
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=1000.0)
    rows = [tuple(r) for r in got.select("a.lo", "a.hi", "b.lo", "a.id", "b.id").collect()]
    assert len(rows) == 30 * 20
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    for _, of in itertools.groupby(rows, key=lambda r: r[3]):
        seen = [r[2] for r in of]
        assert len(seen) == 20 and seen == sorted(seen)


def test_right_rows_of_a_cell_are_few(spark, monkeypatch):
    monkeypatch.setattr(theta, "RUN_ROWS", 16)
    left = spark.range(100).selectExpr("id", "0 AS lo", "1 AS hi").alias("a")
    right = spark.range(400).selectExpr("id", "0 AS lo", "2 AS hi").alias("b")
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=4.0).select("a.id", "b.id").collect()
    assert len(got) == len({tuple(r) for r in got}) == 40_000
    assert max(len(list(g)) for _, g in itertools.groupby(got, key=lambda r: r[0])) < 100  # 25 cells of some 16 right rows


def test_tasks_grow_with_the_pairs_not_with_the_rows(spark, monkeypatch):
    # AQE would merge so few rows into one task; a second shuffle for the join would take the tasks back
    monkeypatch.setattr(theta, "TASK_PAIRS", 400)
    left = spark.range(1000).selectExpr("id", "id div 10 AS lo", "id div 10 AS hi").alias("a")
    right = spark.range(2000).selectExpr("id", "id div 20 AS lo", "id div 20 AS hi").alias("b")
    got = overlap_join(left, right, ("a.lo", "a.hi"), ("b.lo", "b.hi"), width=1.0)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    # a hundred buckets of 10 and 20 rows, 50 tasks
    assert sum(sizes) == 20_000 and 25 < len(sizes) <= 50
    p = explained(got)
    assert p.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(__lcell" in p and "ENSURE_REQUIREMENTS" not in p.split("BroadcastExchange")[0]
