"""Queries over tables of a special layout or write protocol: bucketed tables (S6), batches that are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_location, fresh_table_name
from ..sources.batches import append_batch, read_batches, stage_batch
from ..sources.sinks import bucket_count
from ..sources.tables import parquet_dir_resolver
from .run import run_job


#: Least number of buckets of a joined table, and the size of its rows that one task sorts and joins.
LEAST_BUCKETS, JOINED_BUCKET_BYTES = 8, 16 << 20


def bucketed_join(spark: SparkSession, sf_dir: str, bucket_bytes: int = JOINED_BUCKET_BYTES) -> DataFrame:
    """Orders and lineitem stored in buckets of the order key, then joined and aggregated without a shuffle.

    A bucket is one task of the join, so their number grows with the larger table and a task's memory doesn't; both
    tables have the same number.
    """
    stored = (("orders", "o", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderdate"]),
              ("lineitem", "l", "l_orderkey", ["l_orderkey", "l_extendedprice", "l_quantity"]))
    resolve, names = parquet_dir_resolver(sf_dir), {}
    buckets = max(LEAST_BUCKETS, *(bucket_count(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns), bucket_bytes) for table, _, _, columns in stored))
    for table, alias, key, columns in stored:
        names[table] = fresh_table_name(f"bk_{table}")
        run_job(spark, {
            "tables": [{"name": table, "alias": alias}],
            "transformations": [{"kind": "select", "output_column": c, "expression": c} for c in columns],
            "target": {"table": names[table], "path": fresh_location(spark, f"bk_{table}"), "mode": "overwrite", "bucket_by": [key], "buckets": buckets}},
            resolver=resolve)
    return run_job(spark, {
        "tables": [{"name": names["orders"], "alias": "o"}, {"name": names["lineitem"], "alias": "l"}],
        "joins": [{"type": "inner", "right_table": "l", "conditions": "o.o_orderkey = l.l_orderkey"}],
        "transformations": [
            {"output_column": "", "expression": "group by o.o_orderkey, o.o_custkey"},
            {"output_column": "n_lines", "expression": "count(*)"},
            {"output_column": "sum_price", "expression": "CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2))"},
        ]})


def append_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of orders for each status; one is sent twice, one breaks off before its commit and is sent again."""
    path = fresh_location(spark, "batches")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    batch = {s: orders.where(F.col("o_orderstatus") == s) for s in "FOP"}
    append_batch(batch["F"], path, "status-F")
    append_batch(batch["F"], path, "status-F")                # a retry of what has succeeded
    stage_batch(batch["O"].limit(100), path, "status-O")      # broken off half-way: no commit
    append_batch(batch["O"], path, "status-O")
    append_batch(batch["P"], path, "status-P")
    append_batch(orders, path, "status-P")                    # the same batch with other rows stays as it was
    return read_batches(spark, path)


QUERIES = {"bucketed_join": bucketed_join, "append_replayed": append_replayed}

SQL = {
    "bucketed_join": """
SELECT o_orderkey, o_custkey, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey
""",
    "append_replayed": "SELECT * FROM orders",
}
