"""Boundaries of every rule, list parsing (K1), padding (K5) and empty lists."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkwright.functions import jobs as J

JOB_SCHEMA = ("job_id long, num_tables int, recency int, frequency int, use_spot boolean, sla boolean, "
              "auto_terminate boolean, workload_type string")


def _classify(spark, rows):
    """rows: (num_tables, sizes, join, xf, skew, recency, frequency) as comma text."""
    texts = spark.createDataFrame([Row(job_id=i, table_sizes=r[1], join_complexities=r[2],
                                       transformation_complexities=r[3], data_skews=r[4])
                                   for i, r in enumerate(rows)])
    jobs = spark.createDataFrame([(i, r[0], r[5], r[6], False, False, False, None) for i, r in enumerate(rows)],
                                 JOB_SCHEMA)
    out = J.recommend(jobs, J.lists_to_long(texts)).orderBy("job_id").collect()
    return out


def _scores(r):
    return (r.score_general, r.score_ml, r.score_streaming, r.score_caching)


# neutral base: n=1 (G1 M2), size 10 (S1 G1), join 1, xf 1, skew 1, recency 0, frequency 0
BASE = (1, "10", "1", "1", "1", 0, 0)


def _vary(**kw):
    keys = ["n", "sizes", "join", "xf", "skew", "rec", "freq"]
    vals = list(BASE)
    for k, v in kw.items():
        vals[keys.index(k)] = v
    return tuple(vals)


@pytest.mark.parametrize("n,delta", [(5, (2, 2, 1, 0)), (6, (3, 0, 1, 1)), (15, (3, 0, 1, 1)), (16, (1, 0, 3, 1))])
def test_table_count_boundaries(spark, n, delta):
    # with n tables the single size is repeated, features stay those of the list as given
    r = _classify(spark, [_vary(n=n)])[0]
    assert _scores(r) == delta


@pytest.mark.parametrize("size,expect", [
    ("100", (2, 2, 1, 0)), ("100.0001", (1, 2, 0, 2)), ("500", (1, 2, 0, 2)), ("500.0001", (1, 4, 0, 0)),
    ("1000", (1, 4, 0, 0)), ("1000.0001", (1, 5, 0, 0))])
def test_size_boundaries(spark, size, expect):
    assert _scores(_classify(spark, [_vary(sizes=size)])[0]) == expect


def test_variance_boundary_exact(spark):
    # var_pop of (100, 300) is exactly 10000: not above; (100, 300.0001) is above
    a, b = _classify(spark, [_vary(sizes="100,300"), _vary(sizes="100,300.0001")])
    assert a.var_over_10000 is False and b.var_over_10000 is True
    assert b.score_caching - a.score_caching == 2


@pytest.mark.parametrize("v,expect_g,expect_s,expect_d", [
    ("3.99", 2, 1, 0), ("4", 3, 2, 0), ("7", 3, 2, 0), ("7.01", 2, 1, 2), ("8", 2, 1, 2), ("8.5", 2, 1, 3)])
def test_join_boundaries(spark, v, expect_g, expect_s, expect_d):
    r = _classify(spark, [_vary(join=v)])[0]
    assert (r.score_general, r.score_streaming, r.score_caching) == (expect_g, expect_s, expect_d)


@pytest.mark.parametrize("v,expect_m,expect_s", [("3", 2, 1), ("4", 2, 3), ("7", 2, 3), ("7.5", 4, 1), ("9", 5, 1)])
def test_transformation_boundaries(spark, v, expect_m, expect_s):
    r = _classify(spark, [_vary(xf=v)])[0]
    assert (r.score_ml, r.score_streaming) == (expect_m, expect_s)


@pytest.mark.parametrize("v,expect_s,expect_d", [("3", 1, 0), ("4", 2, 0), ("7", 2, 0), ("8", 1, 2), ("9", 1, 3)])
def test_skew_boundaries(spark, v, expect_s, expect_d):
    r = _classify(spark, [_vary(skew=v)])[0]
    assert (r.score_streaming, r.score_caching) == (expect_s, expect_d)


@pytest.mark.parametrize("v,expect_s,expect_d", [(3, 1, 0), (4, 1, 1), (7, 1, 1), (8, 3, 0)])
def test_recency_and_frequency_boundaries(spark, v, expect_s, expect_d):
    r1, r2 = _classify(spark, [_vary(rec=v), _vary(freq=v)])
    assert (r1.score_streaming, r1.score_caching) == (expect_s, expect_d)
    assert (r2.score_streaming, r2.score_caching) == (expect_s, expect_d)


def test_margin_must_exceed_two(spark):
    # Margin 2 -> General; one more streaming point -> Streaming/ELT
    a, b = _classify(spark, [(1, "10", "5", "5", "5", 5, 5), (1, "10", "5", "5", "5", 5, 8)])
    assert a.computed_type == "General"
    assert b.computed_type == "Streaming/ELT"


@pytest.mark.parametrize("text,expect", [
    ("1, 2 ,3", [1.0, 2.0, 3.0]), ("1,,2, ", [1.0, 2.0]), ("1e2,.5,-3.", [100.0, 0.5, -3.0]),
    ("10,abc", [1.0]), ("1_000", [1.0]), ("10d", [1.0]), ("inf", [1.0]), ("nan,1", [1.0]), ("", []), (None, [])])
def test_list_parsing(spark, text, expect):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.parse_number_list(F.col("t")).alias("a")).first().a == expect


def test_padding_repeats_whole_list_and_cut_keeps_first(spark):
    rows = [(3, "10,20", "1,9", "1", "1", 0, 0), (1, "10,2000", "9,1", "1", "1", 0, 0)]
    a, b = _classify(spark, rows)
    # padding: k=2 < n=3 -> list repeated 3 times: total 90, max join 9
    assert float(a.padded_total_size) == 90.0 and a.padded_max_join == 9.0
    # cutting: n=1 keeps the first item only
    assert float(b.padded_total_size) == 10.0 and b.padded_max_join == 9.0
    # but classification uses the lists as given
    assert float(b.max_size) == 2000.0


def test_lists_of_different_lengths(spark):
    r = _classify(spark, [(2, "10,20,30", "5", "1,2", "3", 0, 0)])[0]
    assert (r.k_size, r.k_join, r.k_xf, r.k_skew) == (3, 1, 2, 1)
    assert float(r.padded_total_size) == 30.0  # first two sizes
    assert r.padded_max_xf == 2.0


def test_empty_list_gives_status_and_null_type(spark):
    r = _classify(spark, [(1, "", "5", "5", "5", 0, 0)])[0]
    assert r.status == "empty list" and r.computed_type is None


def test_pad_last_extends_with_last_item(spark):
    texts = spark.createDataFrame([Row(job_id=1, table_sizes="10,20", join_complexities="1",
                                       transformation_complexities="1", data_skews="1")])
    jobs = spark.createDataFrame([(1, 3, 0, 0, False, False, False, None)], JOB_SCHEMA)
    jt = J.lists_to_long(texts)
    assert float(J.recommend(jobs, jt).first().padded_total_size) == 90.0
    assert float(J.recommend(jobs, jt, pad="last").first().padded_total_size) == 50.0


def test_settings_lines_feed_apply_settings(spark):
    from sparkwright.functions.conf import parse_settings
    texts = spark.createDataFrame([Row(job_id=4, table_sizes="2000", join_complexities="1",
                                       transformation_complexities="9", data_skews="1")])
    jobs = spark.createDataFrame([(4, 2, 0, 0, True, False, False, None)], JOB_SCHEMA)
    lines = J.settings_lines(J.recommend(jobs, J.lists_to_long(texts)), 4)
    assert lines[0] == "spark.sql.shuffle.partitions = 64"
    assert dict(parse_settings(lines))["spark.sql.adaptive.skewJoin.skewedPartitionFactor"] == "5"


def test_variance_is_exact_and_rounded_half_up(spark):
    from decimal import Decimal
    rows = [_vary(sizes="100,300"), _vary(sizes="1,2"), _vary(sizes="1,2,4"), _vary(sizes="0.0001,0.0002"),
            _vary(sizes="7")]
    got = [r.var_size for r in _classify(spark, rows)]
    # 10000 exactly; 0.25; 14/9 = 1.5555.. -> 1.56; 2.5e-9 -> 0.00; a single item -> 0
    assert got == [Decimal("10000.00"), Decimal("0.25"), Decimal("1.56"), Decimal("0.00"), Decimal("0.00")]


def test_sizes_are_not_rounded_and_large_ones_fit(spark):
    """256.00001 GB needs a third core; a 1e15 GB table is a job like any other; many rows do not overflow."""
    from pyspark.sql import functions as F

    jobs = spark.createDataFrame([(k, 1, 1, 1, False, False, False, None) for k in (1, 2, 3, 4)],
                                 "job_id long, num_tables int, recency int, frequency int, use_spot boolean, sla boolean, auto_terminate boolean, workload_type string")
    text = spark.createDataFrame([(1, "256.00001", "1", "1", "1"), (2, "500.00001", "1", "1", "1"), (3, "1e15", "1", "1", "1")],
                                 "job_id long, table_sizes string, join_complexities string, transformation_complexities string, data_skews string")
    many = spark.range(3_200_000).select(F.lit(4).cast("long").alias("job_id"), F.col("id").cast("int").alias("pos"), F.lit(1).cast(J.SIZE).alias("size_gb"),
                                         F.lit(1.0).alias("join_cx"), F.lit(1.0).alias("xf_cx"), F.lit(1.0).alias("skew"))
    tables = J.lists_to_long(text).unionByName(many)
    got = {r.job_id: r for r in J.recommend(jobs, tables).collect()}
    assert got[1].cores == 3 and got[3].cores == 7_812_500_000_000
    assert (got[2].score_ml, got[2].score_caching) == (4, 0)
    assert got[4].status == "ok" and got[4].k_size == 3_200_000
