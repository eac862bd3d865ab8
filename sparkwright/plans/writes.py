"""Sink queries (S6-S9): run a job with a target, then read the table back.

Each call writes to a new location under the shared folder (``spark.checkpoint.dir``), so reruns and
concurrent runs never collide, and the read-back is what the driver compares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_location, fresh_table_name
from ..sources.tables import parquet_dir_resolver
from .run import run_job


def _job(spark: SparkSession, sf_dir: str, spec: dict) -> DataFrame:
    return run_job(spark, spec, resolver=parquet_dir_resolver(sf_dir))


def _orders(status: str, target: dict) -> dict:
    return {"tables": [{"name": "orders", "alias": "o", "predicate": f"o_orderstatus = '{status}'"}],
            "target": target}


def write_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite replaces: the second job's rows are all that remain."""
    name, path = fresh_table_name("w_over"), fresh_location(spark, "w_over")
    _job(spark, sf_dir, _orders("F", {"table": name, "path": path, "mode": "overwrite"}))
    return _job(spark, sf_dir, _orders("O", {"table": name, "path": path, "mode": "overwrite"}))


def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append twice doubles the rows (appended by name)."""
    name, path = fresh_table_name("w_app"), fresh_location(spark, "w_app")
    _job(spark, sf_dir, _orders("F", {"table": name, "path": path, "mode": "append"}))
    return _job(spark, sf_dir, _orders("F", {"table": name, "path": path, "mode": "append"}))


def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static partitions given the saved-job way: comma text of columns and of values."""
    name = fresh_table_name("w_part")
    return _job(spark, sf_dir, {"tables": [{"name": "customer", "alias": "c"}],
                                "output_table": name, "output_path": fresh_location(spark, "w_part"),
                                "write_mode": "overwrite",
                                "partition_columns": "load_region, load_batch", "partition_values": "EU, 7"})


def write_partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all orders partitioned by status, then replace only the 'F' partition."""
    name, path = fresh_table_name("w_repl"), fresh_location(spark, "w_repl")
    _job(spark, sf_dir, {"tables": [{"name": "orders", "alias": "o"}],
                         "target": {"table": name, "path": path, "mode": "overwrite",
                                    "partitions": [{"column": "o_orderstatus", "value": None}]}})
    replacement = {
        "tables": [{"name": "orders", "alias": "o", "predicate": "o_orderstatus = 'F' AND o_totalprice > 200000"}],
        "transformations": [{"kind": "select", "output_column": c, "expression": c} for c in
                            ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")],
        "target": {"table": name, "mode": "overwrite", "replace_partitions": True,
                   "partitions": [{"column": "o_orderstatus", "value": "F"}]},
    }
    return _job(spark, sf_dir, replacement)


SQL = {
    "write_overwrite": "SELECT * FROM orders WHERE o_orderstatus = 'O'",
    "write_append": "SELECT * FROM orders WHERE o_orderstatus = 'F' "
                    "UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "write_partitioned": "SELECT *, 'EU' AS load_region, '7' AS load_batch FROM customer",
    "write_partition_replace": "SELECT * FROM orders WHERE o_orderstatus <> 'F' "
                               "UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
}
