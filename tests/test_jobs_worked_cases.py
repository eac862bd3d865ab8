"""The worked cases of the scoring and sizing rules, end to end from comma text."""

import pytest
from pyspark.sql import Row

from sparkwright.functions import jobs as J

# n; sizes; join; transformation; skew; recency; frequency ->
# scores G/M/S/D, type, total, cores, workers, min, max, shuffle, spot(80%), spot(20%), skew factor
CASES = [
    (1, "10", "5", "5", "5", 5, 5, (3, 2, 5, 2), "General", "10", 2, 2, 1, 4, 4, 1, 0, 5),
    (16, "10", "5", "5", "5", 8, 8, (2, 0, 11, 1), "Streaming/ELT", "160", 2, 2, 1, 4, 4, 1, 0, 5),
    (2, "2000", "1", "9", "1", 0, 0, (1, 8, 0, 0), "ML/High Memory", "4000", 32, 8, 6, 16, 64, 6, 1, 5),
    (10, "200", "9", "1", "9", 5, 5, (2, 0, 0, 11), "Data Caching/Analysis", "2000", 16, 4, 2, 8, 32, 3, 0, 9),
    (6, "1,301", "7", "7", "7", 7, 4, (3, 0, 4, 7), "Data Caching/Analysis", "1812", 15, 4, 2, 8, 30, 3, 0, 7),
    (5, "100", "4", "4", "4", 3, 3, (3, 2, 5, 0), "General", "500", 4, 2, 1, 4, 8, 1, 0, 5),
    (15, "500", "8", "8", "8", 8, 3, (2, 2, 2, 7), "Data Caching/Analysis", "7500", 59, 15, 13, 30, 118, 12, 3, 8),
    (3, "10,20", "5", "5", "5", 5, 5, (3, 2, 5, 2), "General", "90", 2, 2, 1, 4, 4, 1, 0, 5),
]


def _frames(spark, rows, use_spot=True, sla=False):
    texts = spark.createDataFrame([Row(job_id=i, table_sizes=c[1], join_complexities=c[2],
                                       transformation_complexities=c[3], data_skews=c[4])
                                   for i, c in enumerate(rows)])
    jobs = spark.createDataFrame(
        [(i, c[0], c[5], c[6], use_spot, sla, False, None) for i, c in enumerate(rows)],
        "job_id long, num_tables int, recency int, frequency int, use_spot boolean, sla boolean, "
        "auto_terminate boolean, workload_type string")
    return jobs, J.lists_to_long(texts)


@pytest.fixture(scope="module")
def results(spark):
    jobs, jt = _frames(spark, CASES, use_spot=True, sla=False)
    no_sla = {r.job_id: r for r in J.recommend(jobs, jt).collect()}
    jobs2, jt2 = _frames(spark, CASES, use_spot=True, sla=True)
    with_sla = {r.job_id: r for r in J.recommend(jobs2, jt2).collect()}
    return no_sla, with_sla


@pytest.mark.parametrize("i", range(len(CASES)))
def test_worked_case(results, i):
    no_sla, with_sla = results
    c = CASES[i]
    r = no_sla[i]
    assert (r.score_general, r.score_ml, r.score_streaming, r.score_caching) == c[7]
    assert r.computed_type == c[8]
    assert str(r.padded_total_size.normalize()) == str(__import__("decimal").Decimal(c[9]).normalize())
    assert (r.cores, r.workers, r.min_instances, r.max_instances) == c[10:14]
    assert r.spark_conf["spark.sql.shuffle.partitions"] == str(c[14])
    assert r.spot_workers == c[15] and r.on_demand_workers == r.workers - c[15]
    assert with_sla[i].spot_workers == c[16] and with_sla[i].spot_pct == 20
    assert r.spark_conf["spark.sql.adaptive.skewJoin.skewedPartitionFactor"] == str(c[17])


def test_no_spot_is_null_and_all_on_demand(spark):
    jobs, jt = _frames(spark, CASES[:1], use_spot=False)
    r = J.recommend(jobs, jt).collect()[0]
    assert r.spot_pct == 0 and r.spot_workers is None and r.on_demand_workers == r.workers


def test_override_type_drives_sizing(spark):
    jobs, jt = _frames(spark, CASES[:1])
    jobs = jobs.withColumn("workload_type", jobs.job_id.cast("string").substr(0, 0))  # empty -> not null
    from pyspark.sql import functions as F
    jobs = jobs.withColumn("workload_type", F.lit("ML/High Memory"))
    r = J.recommend(jobs, jt).collect()[0]
    assert r.computed_type == "General" and r.sizing_type == "ML/High Memory" and r.instance_type == "r5.xlarge"


def test_advice_order(spark):
    # spot without SLA, auto-termination, all three remedies
    texts = spark.createDataFrame([Row(job_id=1, table_sizes="10", join_complexities="9",
                                       transformation_complexities="9", data_skews="9")])
    jobs = spark.createDataFrame([(1, 1, 5, 5, True, False, True, None)],
                                 "job_id long, num_tables int, recency int, frequency int, use_spot boolean, "
                                 "sla boolean, auto_terminate boolean, workload_type string")
    r = J.recommend(jobs, J.lists_to_long(texts)).collect()[0]
    assert r.advice == [J.ADVICE_SPOT, J.ADVICE_AUTO_TERMINATE, J.ADVICE_BROADCAST, J.ADVICE_SALT, J.ADVICE_CACHE,
                        "Configured auto-scaling with min instances: 1, max instances: 4",
                        J.ADVICE_STEPS, J.ADVICE_COOLDOWN, J.ADVICE_SAFEGUARD]
    assert len(r.spark_conf) == 8


def test_sla_advice_even_without_spot(spark):
    texts = spark.createDataFrame([Row(job_id=1, table_sizes="10", join_complexities="1",
                                       transformation_complexities="1", data_skews="1")])
    jobs = spark.createDataFrame([(1, 1, 5, 5, False, True, False, None)],
                                 "job_id long, num_tables int, recency int, frequency int, use_spot boolean, "
                                 "sla boolean, auto_terminate boolean, workload_type string")
    r = J.recommend(jobs, J.lists_to_long(texts)).collect()[0]
    assert r.advice[0] == J.ADVICE_SLA and len(r.advice) == 5
