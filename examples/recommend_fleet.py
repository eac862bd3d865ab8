"""Recommendations for a whole table of job descriptors, in the form's text shape.

    spark-submit examples/recommend_fleet.py <descriptors table> <output table>

The descriptors table has: job_id, num_tables, table_sizes, join_complexities,
transformation_complexities, data_skews (comma text), use_spot_instances, sla_requirements,
enable_auto_termination (booleans), recency, frequency (0-10) and an optional workload_type override.
"""

import sys

from pyspark.sql import functions as F

from sparkwright import build_session
from sparkwright.functions import jobs as J


def main(source: str, target: str) -> None:
    spark = build_session(app_name="fleet-recommendations")
    rec = J.recommend_from_text(spark.read.table(source))
    (rec.select("job_id", "status", "computed_type", "sizing_type", "cores", "instance_type", "workers",
                "spot_pct", "spot_workers", "on_demand_workers", "min_instances", "max_instances",
                "spark_conf", F.concat_ws("\n", "advice").alias("advice"))
        .write.mode("overwrite").saveAsTable(target))
    J.fleet_summary(rec).show()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
