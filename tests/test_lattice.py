"""Grouping sets from one pass, HAVING, merged distinct counts and sketches."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from sparkwright import run_job
from sparkwright.operators import distincts, lattice
from sparkwright.operators.lattice import Measure


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice(["x", None]), rng.choice([None, rng.randrange(100)]), rng.randrange(1000) / 100)
            for _ in range(2000)]
    return spark.createDataFrame(data + [("zz", None, None, None, None)], "a string, b int, c string, v int, d double")


def explained(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def canon(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


MEASURES = [Measure("n", "count"), Measure("n_v", "count", "v"), Measure("s", "sum", "v"), Measure("lo", "min", "d"), Measure("hi", "max", "d"),
            Measure("mean", "avg", "v")]


def test_cube_equals_sparks_own_with_nulls_in_keys(rows):
    got = lattice.cube(rows, ["a", "b", "c"], MEASURES)
    want = rows.cube("a", "b", "c").agg(F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("n"), F.count("v").alias("n_v"), F.sum("v").alias("s"),
                                        F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("v").alias("mean"))
    assert canon(got, want.columns) == canon(want, want.columns)


def test_rollup_and_having(rows):
    got = lattice.rollup(rows, ["a", "b"], MEASURES[:2], "n > 100 AND a IS NOT NULL")
    want = rows.rollup("a", "b").agg(F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("n"), F.count("v").alias("n_v")).where("n > 100 AND a IS NOT NULL")
    assert canon(got, want.columns) == canon(want, want.columns) and got.count() > 0


def test_var_pop_and_repeated_set(rows):
    got = lattice.grouping_sets(rows, ["a"], [["a"], ["a"], []], [Measure("v", "var_pop", "d")])
    want = {r.a: r.v for r in rows.groupBy("a").agg(F.var_pop("d").alias("v")).collect()}
    found = [r for r in got.collect() if not r.grouping_id]
    assert len(found) == 2 * len(want)
    for r in found:
        assert (r.v is None and want[r.a] is None) or r.v == pytest.approx(want[r.a], rel=1e-9)


def test_fact_is_read_once_and_never_expanded(spark, rows, tmp_path):
    assert "Expand" not in explained(lattice.finest(rows, ["a", "b", "c"], MEASURES))
    got = explained(lattice.cube(rows, ["a", "b", "c"], MEASURES))
    # what is left to compute reads the written finest level alone
    assert "Expand" not in got and "LocalTableScan" not in got and "ExistingRDD" not in got
    assert all("/lattice_" in line for line in got.splitlines() if "FileScan" in line)


def test_sets_are_derived_from_the_smallest_finer_one():
    sets = lattice.cube_sets(["a", "b", "c"])
    found = lattice.parents(sets, ["a", "b", "c"], {"a": 1000, "b": 3, "c": 10}, 20_000)
    assert found[("b", "c")] == ("a", "b", "c") and found[("b",)] == ("b", "c") and found[("a",)] == ("a", "b") and found[()] == ("b",)
    assert ("a", "b", "c") not in found


def test_empty_input(spark, rows):
    got = lattice.cube(rows.where("false"), ["a", "b"], [Measure("n", "count"), Measure("s", "sum", "v")]).collect()
    # as in SQL, only the set without keys has a row
    assert [tuple(r) for r in got] == [(None, None, 3, None, None)] or [(r.grouping_id, r.n or 0, r.s) for r in got] == [(3, 0, None)]


@pytest.mark.parametrize("text", ["sum(x) / count(*)", "count(distinct x)", "percentile(x, 0.5)", "cast(sum(x) + 1 as int)"])
def test_aggregates_that_do_not_merge_are_refused(text):
    with pytest.raises(ValueError, match="merges"):
        lattice.measure_of("y", text)


def test_aggregate_text():
    m = lattice.measure_of("y", "CAST(sum(CAST(x AS DECIMAL(18,2))) AS DECIMAL(38,2))")
    assert (m.func, m.value, m.cast) == ("sum", "CAST(x AS DECIMAL(18,2))", "DECIMAL(38,2)")
    assert lattice.measure_of("y", "count(*)").value is None and lattice.measure_of("y", "count(x)").value == "x"


def test_spec_errors(spark, rows):
    def job(**more):
        return run_job(spark, {"tables": [{"name": "t", "alias": "t"}], **more}, resolver=lambda *a, **k: rows).collect()

    group = {"output_column": "", "expression": "group by cube(a, b)"}
    with pytest.raises(ValueError, match="need aggregates"):
        job(transformations=[group])
    with pytest.raises(ValueError, match="stands alone"):
        job(transformations=[group, {"output_column": "", "expression": "group by c"}, {"output_column": "n", "expression": "count(*)"}])
    with pytest.raises(ValueError, match="having"):
        job(transformations=[{"output_column": "x", "expression": "a"}], having="x = 1")
    with pytest.raises(ValueError, match="AS name"):
        job(transformations=[{"output_column": "", "expression": "group by rollup(upper(a), b)"}, {"output_column": "n", "expression": "count(*)"}])


def test_distinct_levels_merge_exactly(rows):
    df = rows.withColumn("w", F.col("v") * 1000)  # several ranges of codes
    got = distincts.distinct_levels(df, {"a": "a", "b": "b"}, [("ab", {"a": "a", "b": "b"}), ("b", {"b": "b"}), ("all", {})], {"n_v": "v", "n_w": "w"})
    found = {(r.level, r.a, r.b): (r.n_v, r.n_w) for r in got.collect()}
    for level, keys in (("ab", ["a", "b"]), ("b", ["b"]), ("all", [])):
        for r in df.groupBy(*keys).agg(F.count_distinct("v").alias("n_v"), F.count_distinct("w").alias("n_w")).collect():
            d = r.asDict()
            assert found.pop((level, d.get("a"), d.get("b"))) == (r.n_v, r.n_w)
    assert not found  # a group without values counts 0 and is there


def test_dense_codes_are_the_sorted_places(spark):
    values = [f"k{i % 977:04d}" for i in range(5000)] + [None, ""]
    got = distincts.dense_codes(spark.createDataFrame([(v,) for v in values], "k string").repartition(7), "k").collect()
    want = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    assert {r.value: r.code for r in got} == want and len(got) == len(want)


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).selectExpr("id % 7 AS g", "id % 12 AS h", "id % 20011 AS x", "CAST(id AS DOUBLE) AS y")
    m = [Measure("d", "approx_distinct", "x"), Measure("q", "quantile", "y", rank=0.9)]
    for r in lattice.rollup(df, ["g", "h"], m).collect():
        if r.grouping_id == 3:
            assert abs(r.d - 20011) < 0.025 * 20011 and abs(r.q - 54_000) < 0.02 * 60_000
    empty = lattice.rollup(df.where("false"), ["g"], m).collect()
    assert all(r.q is None for r in empty)
