"""Window queries whose hot keys need more than split points of the first ordering column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.range_frames import range_window
from ..operators.lattice import Measure
from ..operators.windows import WinOut, skew_safe_window
from ..sources.tables import parquet_dir_resolver
from .run import run_job


def window_range_hot(spark, sf_dir):
    """A RANGE frame of time (six hours back) and one of a number (25 either way), hot users split with their borders
    copied."""
    by_time = {"func": "range", "partition_by": ["user_id"], "order_by": "ts", "preceding": "INTERVAL 6 HOURS", "hot_fraction": 0.005, "buckets": 4}
    by_value = {**by_time, "order_by": "CAST(value AS DECIMAL(18,2))", "preceding": "25", "following": "25"}
    over_time = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)"
    over_value = "OVER (PARTITION BY user_id ORDER BY CAST(value AS DECIMAL(18,2)) RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)"
    return run_job(spark, {
        "tables": [{"name": "events", "alias": "e"}],
        "transformations": [
            {"output_column": "sum_6h", "expression": f"sum(CAST(value AS DECIMAL(18,2))) {over_time}",
             "skew_safe": {**by_time, "agg": "sum", "value": "CAST(value AS DECIMAL(18,2))", "cast": "decimal(38,2)"}},
            {"output_column": "n_alike", "expression": f"count(*) {over_value}", "skew_safe": {**by_value, "agg": "count"}},
            {"output_column": "last_alike", "expression": f"max(ts) {over_value}", "skew_safe": {**by_value, "agg": "max", "value": "ts"}},
        ],
    }, resolver=parquet_dir_resolver(sf_dir))


def window_rank_ties(spark, sf_dir):
    """Numbering, rank, lag and lead by columns that hardly differ first, in mixed directions: whole tuples split the
    hot groups."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("same", F.lit("constant"))
    order = [("same", True), ("user_id", False), ("ts", True), ("event_id", True)]
    out = skew_safe_window(events, ["event_type"], order, [
        WinOut("row_number", "place", cast="int"), WinOut("lag", "before", "event_id"), WinOut("lead", "third_next", "event_id", offset=3),
        WinOut("running_sum", "total", "CAST(value AS DECIMAL(18,2))", cast="decimal(38,2)")], hot_fraction=0.05, buckets=8)
    out = skew_safe_window(out, ["event_type"], order[:2], [WinOut("rank", "user_rank", cast="int"), WinOut("dense_rank", "user_dense", cast="int")],
                           hot_fraction=0.05, buckets=8)
    return out.drop("same")


QUERIES = {"window_range_hot": window_range_hot, "window_rank_ties": window_rank_ties}

SQL = {
    "window_range_hot": """
SELECT *, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS sum_6h,
  count(*) OVER w AS n_alike, max(ts) OVER w AS last_alike
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(value AS DECIMAL(18,2)) RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)
""",
    "window_rank_ties": """
SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, lag(event_id) OVER w AS before, lead(event_id, 3) OVER w AS third_next,
  CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DECIMAL(38,2)) AS total,
  CAST(rank() OVER u AS INTEGER) AS user_rank, CAST(dense_rank() OVER u AS INTEGER) AS user_dense
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id DESC, ts, event_id), u AS (PARTITION BY event_type ORDER BY user_id DESC)
""",
}
