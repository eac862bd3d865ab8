"""Queries of several grouping levels: cube, grouping sets, having, merged distinct counts and merged sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distincts, lattice
from ..operators.joins import broadcast_join
from ..operators.lattice import Measure
from ..session import fresh_location
from ..sources.tables import parquet_dir_resolver
from .run import run_job

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DECIMAL(38,2))"


def _run(spark: SparkSession, sf_dir: str, spec: dict) -> DataFrame:
    return run_job(spark, spec, resolver=parquet_dir_resolver(sf_dir))


def group_cube(spark, sf_dir):
    """A cube over three keys with HAVING, from one pass over the fact."""
    return _run(spark, sf_dir, {
        "tables": [{"name": "lineitem", "alias": "l"}],
        "transformations": [
            {"output_column": "", "expression": "group by cube(l.l_returnflag, l.l_linestatus, l.l_linenumber)"},
            {"output_column": "n_lines", "expression": "count(*)"},
            {"output_column": "sum_price", "expression": MONEY.format("l.l_extendedprice")},
            {"output_column": "avg_qty", "expression": "avg(CAST(l.l_quantity AS DECIMAL(18,2)))"},
            {"output_column": "max_discount", "expression": "max(l.l_discount)"},
            {"output_column": "first_ship", "expression": "min(l.l_shipdate)"},
        ],
        "having": "n_lines > 10 AND sum_price > 100000",
    })


def group_sets(spark, sf_dir):
    """Grouping sets over a join and a derived key; a key that is null only where it is aggregated away."""
    return _run(spark, sf_dir, {
        "tables": [{"name": "orders", "alias": "o"}, {"name": "customer", "alias": "c"}],
        "joins": [{"type": "inner", "right_table": "c", "conditions": "o.o_custkey = c.c_custkey"}],
        "transformations": [
            {"output_column": "", "expression": "group by grouping sets ((c.c_mktsegment, o.o_orderpriority), "
                                                "(CAST(year(o.o_orderdate) AS INT) AS order_year, o.o_orderpriority), (c.c_mktsegment), ())"},
            {"output_column": "n_orders", "expression": "count(*)"},
            {"output_column": "sum_price", "expression": MONEY.format("o.o_totalprice")},
            {"output_column": "var_price", "kind": "agg", "expression": "CAST(var_pop(o.o_totalprice) AS DECIMAL(30,1))"},
        ],
    })


def group_having(spark, sf_dir):
    """HAVING over plain group keys."""
    return _run(spark, sf_dir, {
        "tables": [{"name": "orders", "alias": "o"}],
        "transformations": [
            {"output_column": "", "expression": "group by o_custkey"},
            {"output_column": "n_orders", "expression": "count(*)"},
            {"output_column": "max_price", "expression": "max(o_totalprice)"},
        ],
        "having": "n_orders >= 12 AND max_price > 300000",
    })


def distinct_bitmaps(spark, sf_dir):
    """Exact distinct parts and suppliers by day, month and in all, each level merged from the one below."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = distincts.distinct_levels(
        items, {"period": "CAST(l_shipdate AS DATE)"},
        [("day", {"period": "period"}), ("month", {"period": "CAST(trunc(period, 'MM') AS DATE)"}), ("all", {})],
        {"n_parts": "l_partkey", "n_suppliers": "l_suppkey"})
    return out


def distinct_codes(spark, sf_dir):
    """Distinct part names and brands sold by ship year and status, then by year: text values get dense codes first."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    names, brands = distincts.dense_codes(parts, "p_name"), distincts.dense_codes(parts, "p_brand")
    coded = (parts.join(names.select(F.col("value").alias("p_name"), F.col("code").alias("name_code")), "p_name")
             .join(brands.select(F.col("value").alias("p_brand"), F.col("code").alias("brand_code")), "p_brand").select("p_partkey", "name_code", "brand_code"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_linestatus", "l_shipdate")
    rows = items.join(coded, F.col("l_partkey") == F.col("p_partkey"), "left")
    return distincts.distinct_levels(
        rows, {"ship_year": "CAST(year(l_shipdate) AS INT)", "l_linestatus": "l_linestatus"},
        [("year_status", {"ship_year": "ship_year", "l_linestatus": "l_linestatus"}), ("year", {"ship_year": "ship_year"})],
        {"n_names": "name_code", "n_brands": "brand_code"})


#: Three standard errors of HyperLogLog with 2^14 registers; rank error of a KLL sketch with k = 400, with room for merges.
HLL_ERROR, KLL_ERROR = 0.025, 0.02


def sketch_rollup(spark, sf_dir):
    """Sketches of distinct orders and of the median price, stored by flag, status and month, merged by flag; exact
    rows and distinct orders, and whether the merged estimates lie within the stated errors."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    measures = [Measure("n_rows", "count"), Measure("approx_orders", "approx_distinct", "l_orderkey", accuracy=14),
                Measure("median", "quantile", "l_extendedprice", accuracy=400)]
    stored = fresh_location(spark, "sketches")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    lattice.finest(items, ["l_returnflag", "l_linestatus", month], measures).write.parquet(stored)
    merged = lattice.coarser(spark.read.parquet(stored), ["l_returnflag"], measures).select("l_returnflag", *[m.finish() for m in measures])

    exact = distincts.counts(distincts.bitmaps(items, ["l_returnflag"], {"n_orders": "l_orderkey"}), ["l_returnflag"], ["n_orders"])
    # the estimate's rank among the rows: between the share below it and the share up to it
    medians = merged.select(F.col("l_returnflag").alias("flag"), "median")
    ranks = broadcast_join(items, medians, "l_returnflag <=> flag").groupBy("flag").agg(
        F.avg((F.col("l_extendedprice") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("upto"))
    out = merged.join(exact, "l_returnflag").join(ranks, F.col("l_returnflag") == F.col("flag"))
    return out.select("l_returnflag", F.col("n_rows").cast("bigint").alias("n_rows"), "n_orders",
                      (F.abs(F.col("approx_orders") - F.col("n_orders")) <= HLL_ERROR * F.col("n_orders")).alias("orders_within"),
                      ((F.col("below") <= 0.5 + KLL_ERROR) & (F.col("upto") >= 0.5 - KLL_ERROR)).alias("median_within"))


QUERIES = {
    "group_cube": group_cube,
    "group_sets": group_sets,
    "group_having": group_having,
    "distinct_bitmaps": distinct_bitmaps,
    "distinct_codes": distinct_codes,
    "sketch_rollup": sketch_rollup,
}

SQL = {
    "group_cube": """
SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS grouping_id,
  count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS avg_qty, max(l_discount) AS max_discount, min(l_shipdate) AS first_ship
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)
HAVING count(*) > 10 AND sum(CAST(l_extendedprice AS DECIMAL(18,2))) > 100000
""",
    "group_sets": """
SELECT c_mktsegment, o_orderpriority, order_year,
  CAST(grouping_id(c_mktsegment, o_orderpriority, order_year) AS BIGINT) AS grouping_id, count(*) AS n_orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, CAST(var_pop(o_totalprice) AS DECIMAL(30,1)) AS var_price
FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY GROUPING SETS ((c_mktsegment, o_orderpriority), (order_year, o_orderpriority), (c_mktsegment), ())
""",
    "group_having": """
SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price FROM orders
GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 300000
""",
    "distinct_bitmaps": """
SELECT 'day' AS level, CAST(l_shipdate AS DATE) AS period, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem GROUP BY 2
UNION ALL
SELECT 'month', CAST(date_trunc('month', l_shipdate) AS DATE), count(DISTINCT l_partkey), count(DISTINCT l_suppkey) FROM lineitem GROUP BY 2
UNION ALL
SELECT 'all', NULL, count(DISTINCT l_partkey), count(DISTINCT l_suppkey) FROM lineitem
""",
    "distinct_codes": """
WITH j AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_linestatus, p_name, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT 'year_status' AS level, ship_year, l_linestatus, count(DISTINCT p_name) AS n_names, count(DISTINCT p_brand) AS n_brands FROM j GROUP BY 2, 3
UNION ALL
SELECT 'year', ship_year, NULL, count(DISTINCT p_name), count(DISTINCT p_brand) FROM j GROUP BY 2
""",
    "sketch_rollup": """
SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, true AS orders_within, true AS median_within
FROM lineitem GROUP BY l_returnflag
""",
}
