"""Recommendations from comma text are worked out within the row and equal those over the long form."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkwright.functions import jobs as J

SMOKE = E.SMOKE_DIR


def test_text_path_has_no_exchange(spark):
    plan = E.queries()["job_text_recommend"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Exchange", "Generate", "HashJoin", "SortMergeJoin", "Aggregate ", "Python"):
        assert operator not in plan, operator


def test_text_path_equals_long_form(spark):
    rng = random.Random(3)
    item = lambda: rng.choice([str(rng.randrange(900)), f"{rng.random() * 50:.3f}", " 7 ", "1e2", ""])
    lists = lambda: ",".join(item() for _ in range(rng.randrange(7))) if rng.random() < 0.9 else rng.choice(["x,1", None, " , ", "-4"])
    rows = [(i, rng.choice([None, 0, 1, 3, 8, 20]), lists(), lists(), lists(), lists(), rng.random() < 0.5, rng.random() < 0.3, None,
             rng.randrange(11), rng.randrange(11), rng.choice([None, "General"])) for i in range(300)]
    texts = spark.createDataFrame(rows, "job_id long, num_tables int, table_sizes string, join_complexities string, transformation_complexities string, "
                                        "data_skews string, use_spot_instances boolean, sla_requirements boolean, enable_auto_termination boolean, "
                                        "recency int, frequency int, workload_type string")
    jobs = texts.select("job_id", "num_tables", "recency", "frequency", F.col("use_spot_instances").alias("use_spot"), F.col("sla_requirements").alias("sla"),
                        F.lit(False).alias("auto_terminate"), "workload_type")
    for pad in ("repeat", "last"):
        want = {r.job_id: r.asDict() for r in J.recommend(jobs, J.lists_to_long(texts), pad=pad).collect()}
        got = J.recommend_from_text(texts, pad=pad)
        assert set(got.columns) == set(next(iter(want.values())))
        for r in got.collect():
            for name, value in want[r.job_id].items():
                mine = r[name]
                if isinstance(value, float):
                    assert abs(mine - value) <= 1e-9 * max(1, abs(value)), (r.job_id, name)
                elif name in ("var_size", "avg_size") and value is not None:
                    assert abs(mine - value) <= 1e-2, (r.job_id, name)
                else:
                    assert mine == value, (r.job_id, name, mine, value)
