"""Job-fleet queries (K1-K15) over job descriptors derived from lineitem, plus their DuckDB oracles.

Derived jobs (one per order): ``job_id = l_orderkey``; one list position per line, ordered by
``l_linenumber, l_partkey, l_suppkey, l_shipdate``; size ``l_extendedprice / 100`` GB (decimal), join
complexity ``1 + l_quantity % 10``, transformation complexity ``1 + l_partkey % 10``, skew
``1 + l_suppkey % 10``; recency ``key % 11``, frequency ``key * 7 % 11``; ``num_tables`` = the line count, or
``1 + key % 8`` for the padded variants (to force both padding and cutting); spot when ``key % 2 = 0``,
SLA when ``key % 3 = 0``, auto-termination when ``key % 3 = 1``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jobs as J
from ..functions.conf import settings_table
from ..operators.partitioning import spread_if_narrow
from ..operators.profile import column_profile as _heavy
from ..operators.skew import key_skew_profile as _profile
from ..operators.windows import WinOut, skew_safe_window


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")


def derived_job_tables(lineitem: DataFrame, skew_safe: bool = False) -> DataFrame:
    """One list position per line. The key is renamed before the window, so the window's hash partitioning
    on job_id carries straight into the join with jobs (no second shuffle of the lines). With
    ``skew_safe`` the numbering runs through :func:`skew_safe_window`, which splits an order holding a
    large share of all lines into ordered buckets. Plans that prune ``pos`` never run the window at all."""
    lines = lineitem.select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_extendedprice").cast("decimal(18,2)") / 100).cast(J.SIZE).alias("size_gb"),
        (1 + F.col("l_quantity") % 10).cast("double").alias("join_cx"),
        (1 + F.col("l_partkey") % 10).cast("double").alias("xf_cx"),
        (1 + F.col("l_suppkey") % 10).cast("double").alias("skew"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    if skew_safe:
        numbered = skew_safe_window(lines, ["job_id"], [(c, True) for c in order],
                                    [WinOut("row_number", "__rn")])
        rn = F.col("__rn")
    else:
        numbered, rn = lines, F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return numbered.select("job_id", (rn - 1).cast("int").alias("pos"), "size_gb", "join_cx", "xf_cx", "skew")


def derived_jobs(lineitem: DataFrame, padded: bool = False) -> DataFrame:
    """One job per order: line count (or 1 + key % 8 when padded) and the flag rules above."""
    k = F.col("job_id")
    base = lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    n = (1 + k % 8) if padded else F.col("n_lines")
    return base.select(
        "job_id", n.cast("int").alias("num_tables"),
        (k % 11).cast("int").alias("recency"), (k * 7 % 11).cast("int").alias("frequency"),
        (k % 2 == 0).alias("use_spot"), (k % 3 == 0).alias("sla"), (k % 3 == 1).alias("auto_terminate"),
        F.lit(None).cast("string").alias("workload_type"))


def _recommend(spark: SparkSession, sf_dir: str, padded: bool) -> DataFrame:
    # sizing reads the padded lists, so the positions are needed: number them with hot orders split
    li = _lineitem(spark, sf_dir)
    return J.recommend(derived_jobs(li, padded), derived_job_tables(li, skew_safe=True))


# ---------------------------------------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------------------------------------

def _as(name, kind):
    """The library keeps ten decimals; the derived sizes have four, which the queries report."""
    return F.col(name).cast(kind).alias(name)


def job_features(spark, sf_dir):
    """K2: list statistics as given, per derived job."""
    li = _lineitem(spark, sf_dir)
    f = J.job_features(derived_jobs(li), derived_job_tables(li))
    return f.select("job_id", "num_tables", "k_size", _as("total_size", "decimal(38,4)"), _as("avg_size", "decimal(38,8)"),
                    _as("max_size", "decimal(18,4)"), F.col("var_size").cast("decimal(38,2)").alias("var_size"), "var_over_10000",
                    "avg_join", "max_join", "avg_xf", "max_xf", "avg_skew", "max_skew")


def job_scores(spark, sf_dir):
    """K3: the four rule scores per derived job."""
    li = _lineitem(spark, sf_dir)
    c = J.classify_jobs(derived_jobs(li), derived_job_tables(li))
    return c.select("job_id", "score_general", "score_ml", "score_streaming", "score_caching")


def workload_type(spark, sf_dir):
    """K4: the computed workload type per derived job."""
    li = _lineitem(spark, sf_dir)
    c = J.classify_jobs(derived_jobs(li), derived_job_tables(li))
    return c.select("job_id", F.col("computed_type").alias("workload_type"))


def job_sizing(spark, sf_dir):
    """Cores, instance family, workers and autoscale bounds per derived job."""
    r = _recommend(spark, sf_dir, padded=False)
    return r.select("job_id", "sizing_type", _as("padded_total_size", "decimal(38,4)"), "cores", "instance_type", "instance_cores",
                    "instance_memory_gb", "workers", "min_instances", "max_instances", "scale_out_step",
                    "scale_in_step", "cooldown_seconds", "max_execution_seconds")


def fleet_summary(spark, sf_dir):
    """Jobs and cores per sizing type."""
    return J.fleet_summary(_recommend(spark, sf_dir, padded=False))


def job_padded_size(spark, sf_dir):
    """K5: lists padded (whole list repeated) or cut to num_tables."""
    r = _recommend(spark, sf_dir, padded=True)
    return r.select("job_id", "num_tables", "k_size", _as("padded_total_size", "decimal(38,4)"), "padded_max_join", "padded_max_xf",
                    "padded_max_skew", "cores")


def job_padded_last(spark, sf_dir):
    """K5 with D22's option: short lists are extended with their last item instead of repeated whole."""
    li = _lineitem(spark, sf_dir)
    f = J.job_features(derived_jobs(li, padded=True), derived_job_tables(li, skew_safe=True), pad="last")
    return f.select("job_id", "num_tables", "k_size", _as("padded_total_size", "decimal(38,4)"))


def job_spot_split(spark, sf_dir):
    """K9: spot percentage and the spot / on-demand split."""
    r = _recommend(spark, sf_dir, padded=True)
    return r.select("job_id", "use_spot", "sla", "workers", "spot_pct", "spot_workers", "on_demand_workers")


def job_spark_conf(spark, sf_dir):
    """The eight settings, one row per (job, setting)."""
    return J.conf_rows(_recommend(spark, sf_dir, padded=True))


def job_advice(spark, sf_dir):
    """The advice lines in order, joined by newlines."""
    r = _recommend(spark, sf_dir, padded=True)
    return r.select("job_id", F.size("advice").cast("int").alias("n_advice"),
                    F.concat_ws("\n", "advice").alias("advice_text"))


def list_texts(lineitem: DataFrame) -> DataFrame:
    """Comma text per line, the way a user types it into the form: numbers, blanks, an exponent, and for
    some lines a bad item (which turns that list into the default)."""
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat_ws(",",
                    F.col("l_quantity").cast("bigint").cast("string"),
                    (F.col("l_partkey") % 100).cast("string"),
                    F.when(F.col("l_suppkey") % 13 == 0, F.lit("x"))
                     .otherwise((F.col("l_suppkey") % 50).cast("string")),
                    F.when(F.col("l_linenumber") % 4 == 0, F.lit(" ")).otherwise(F.lit("7.5")),
                    F.when(F.col("l_orderkey") % 7 == 0, F.lit("1e2")).otherwise(F.lit(""))).alias("list_text"))


def job_list_parse(spark, sf_dir):
    """K1: comma text parsed to numbers; any bad item gives the default list."""
    t = spread_if_narrow(list_texts(_lineitem(spark, sf_dir)))
    arr = J.parse_number_list(F.col("list_text"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.size(arr).cast("int").alias("n_items"),
                    J.list_has_bad_item(F.col("list_text")).alias("is_default"),
                    F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x).alias("sum_items"),
                    F.array_max(arr).alias("max_item"))


def order_descriptors(orders: DataFrame) -> DataFrame:
    """One job descriptor per order, in the form's text shape, built from that order's own columns: lists
    of different lengths, blanks, a decimal item, an occasional bad item, and a type override on some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda e: e.cast("string")
    return orders.select(
        k.alias("job_id"), (1 + k % 20).cast("int").alias("num_tables"),
        F.concat_ws(",", s(F.round(F.col("o_totalprice") / 1000).cast("bigint")), s(c % 700),
                    F.when(k % 17 == 0, F.lit("x")).otherwise(F.lit(""))).alias("table_sizes"),
        F.concat_ws(",", s(1 + k % 10), s(1 + c % 10)).alias("join_complexities"),
        s(1 + (k * 3) % 10).alias("transformation_complexities"),
        F.concat_ws(",", s(1 + c % 9), F.lit(" "), F.lit("7.5")).alias("data_skews"),
        (F.col("o_orderstatus") != "P").alias("use_spot_instances"),
        (F.col("o_orderpriority") == "1-URGENT").alias("sla_requirements"),
        (F.col("o_orderstatus") == "F").alias("enable_auto_termination"),
        (k % 11).cast("int").alias("recency"), (c % 11).cast("int").alias("frequency"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("General")).alias("workload_type"))


def job_text_recommend(spark, sf_dir):
    """K1-K12 from descriptors in the form's text shape, one per order."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    r = J.recommend_from_text(order_descriptors(orders))
    return r.select("job_id", "status", F.col("computed_type").alias("computed_type"), "sizing_type",
                    _as("padded_total_size", "decimal(38,4)"), "cores", "workers", "spot_workers", "on_demand_workers",
                    F.col("spark_conf").getItem("spark.sql.adaptive.skewJoin.skewedPartitionFactor")
                    .alias("skew_factor"), F.size("advice").cast("int").alias("n_advice"))


def setting_texts(spark, sf_dir):
    """The settings in one text per order (notes, blanks and cluster settings among them), and which a session may set."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("note: for order "), k, F.lit("\n  spark.sql.shuffle.partitions = "), F.concat(k, F.lit("  \n\n")),
                    F.lit("spark.executor.cores=4\nspark.sql.warehouse.dir = /w/"), F.col("o_orderstatus"), F.lit("\nspark.sql.adaptive.enabled = true"))
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    return settings_table(orders.select("o_orderkey", text.alias("settings"))).withColumn("line", F.col("line").cast("int"))


def key_skew_profile(spark, sf_dir):
    """Rows, keys, largest key and a 1-10 skew score per profiled column."""
    li = _lineitem(spark, sf_dir)
    return _profile(li, ["l_suppkey", "l_partkey", "l_orderkey"], table_name="lineitem")


def column_profile(spark, sf_dir):
    """K14 for every column: the values of at least 5 % of the lines, counted exactly; two scans, no shuffle of lines."""
    return _heavy(_lineitem(spark, sf_dir).withColumn("l_shipyear", F.year("l_shipdate").cast("int")), share=0.05)


def cached_branches(spark, sf_dir):
    """One join result persisted (memory, spilling to disk) and read by two aggregates.

    If an executor holding cached blocks is lost, Spark recomputes just those partitions from lineage.
    """
    li = _lineitem(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    joined = (li.join(part, li.l_partkey == part.p_partkey)
                .select("l_returnflag", "p_brand", "l_quantity").persist(StorageLevel.MEMORY_AND_DISK))
    qty = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(38,2)")
    by_brand = joined.groupBy(F.lit("brand").alias("branch"), F.col("p_brand").alias("grp")) \
                     .agg(F.count(F.lit(1)).alias("n_lines"), qty.alias("sum_qty"))
    by_flag = joined.groupBy(F.lit("returnflag").alias("branch"), F.col("l_returnflag").alias("grp")) \
                    .agg(F.count(F.lit(1)).alias("n_lines"), qty.alias("sum_qty"))
    return by_brand.unionByName(by_flag)


QUERIES = {
    "job_list_parse": job_list_parse,
    "job_text_recommend": job_text_recommend,
    "setting_texts": setting_texts,
    "job_features": job_features,
    "job_scores": job_scores,
    "workload_type": workload_type,
    "job_sizing": job_sizing,
    "job_padded_size": job_padded_size,
    "job_padded_last": job_padded_last,
    "job_spot_split": job_spot_split,
    "job_spark_conf": job_spark_conf,
    "job_advice": job_advice,
    "fleet_summary": fleet_summary,
    "key_skew_profile": key_skew_profile,
    "column_profile": column_profile,
    "cached_branches": cached_branches,
}


# ---------------------------------------------------------------------------------------------------------
# DuckDB oracles: the same rules written as plain SQL
# ---------------------------------------------------------------------------------------------------------

def _derived_sources(padded: bool) -> str:
    n = "CAST(1 + l_orderkey % 8 AS INTEGER)" if padded else "CAST(count(*) AS INTEGER)"
    return f"""
WITH jt AS (
  SELECT l_orderkey AS job_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS pos,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / 100 AS DECIMAL(18,4)) AS size_gb,
         CAST(1 + l_quantity % 10 AS DOUBLE) AS join_cx,
         CAST(1 + l_partkey % 10 AS DOUBLE) AS xf_cx,
         CAST(1 + l_suppkey % 10 AS DOUBLE) AS skew
  FROM lineitem),
jobs AS (
  SELECT l_orderkey AS job_id, {n} AS num_tables,
         CAST(l_orderkey % 11 AS INTEGER) AS recency, CAST(l_orderkey * 7 % 11 AS INTEGER) AS frequency,
         l_orderkey % 2 = 0 AS use_spot, l_orderkey % 3 = 0 AS sla, l_orderkey % 3 = 1 AS auto_terminate,
         CAST(NULL AS VARCHAR) AS workload_type
  FROM lineitem GROUP BY l_orderkey),
"""


def _parse_sql(col: str) -> str:
    """The list rule in DuckDB: split, trim, drop blanks; any bad item -> [1.0]."""
    items = f"list_filter(list_transform(string_split(coalesce({col}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
    return (f"CASE WHEN coalesce(list_bool_or(list_transform({items}, "
            f"lambda x: NOT regexp_full_match(x, '{J.NUMBER_RE}'))), false) "
            f"THEN [1.0::DOUBLE] ELSE list_transform({items}, lambda x: CAST(x AS DOUBLE)) END")


_TEXT_SOURCES = f"""
WITH src AS (
  SELECT o_orderkey AS job_id, CAST(1 + o_orderkey % 20 AS INTEGER) AS num_tables,
         concat_ws(',', CAST(CAST(round(o_totalprice / 1000) AS BIGINT) AS VARCHAR), CAST(o_custkey % 700 AS VARCHAR),
                   CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE '' END) AS table_sizes,
         concat_ws(',', CAST(1 + o_orderkey % 10 AS VARCHAR), CAST(1 + o_custkey % 10 AS VARCHAR)) AS join_complexities,
         CAST(1 + (o_orderkey * 3) % 10 AS VARCHAR) AS transformation_complexities,
         concat_ws(',', CAST(1 + o_custkey % 9 AS VARCHAR), ' ', '7.5') AS data_skews,
         o_orderstatus <> 'P' AS use_spot, o_orderpriority = '1-URGENT' AS sla, o_orderstatus = 'F' AS auto_terminate,
         CAST(o_orderkey % 11 AS INTEGER) AS recency, CAST(o_custkey % 11 AS INTEGER) AS frequency,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'General' END AS workload_type
  FROM orders),
lists AS (
  SELECT *, {_parse_sql('table_sizes')} AS l_size, {_parse_sql('join_complexities')} AS l_join,
         {_parse_sql('transformation_complexities')} AS l_xf, {_parse_sql('data_skews')} AS l_skew FROM src),
pos AS (
  SELECT job_id, l_size, l_join, l_xf, l_skew,
         unnest(range(0, greatest(len(l_size), len(l_join), len(l_xf), len(l_skew)))) AS pos FROM lists),
jt AS (
  SELECT job_id, CAST(pos AS INTEGER) AS pos, CAST(l_size[pos + 1] AS DECIMAL(18,4)) AS size_gb,
         l_join[pos + 1] AS join_cx, l_xf[pos + 1] AS xf_cx, l_skew[pos + 1] AS skew FROM pos),
jobs AS (
  SELECT job_id, num_tables, recency, frequency, use_spot, sla, auto_terminate, workload_type FROM src),
"""


def _cte(padded: bool, sources: str | None = None) -> str:
    return (sources or _derived_sources(padded)) + """f AS (
  SELECT jt.job_id, jobs.num_tables, jobs.recency, jobs.frequency, jobs.use_spot, jobs.sla, jobs.auto_terminate,
         jobs.workload_type AS override_type,
         count(size_gb) AS k_size, count(join_cx) AS k_join, count(xf_cx) AS k_xf, count(skew) AS k_skew,
         CAST(sum(size_gb) AS DECIMAL(38,4)) AS total_size,
         CAST(avg(size_gb) AS DECIMAL(38,8)) AS avg_size,
         max(size_gb) AS max_size,
         CAST(count(size_gb) AS HUGEINT) * sum(CAST(size_gb * 10000 AS HUGEINT) * CAST(size_gb * 10000 AS HUGEINT))
           - sum(CAST(size_gb * 10000 AS HUGEINT)) * sum(CAST(size_gb * 10000 AS HUGEINT)) AS var_num,
         avg(join_cx) AS avg_join, max(join_cx) AS max_join,
         avg(xf_cx) AS avg_xf, max(xf_cx) AS max_xf,
         avg(skew) AS avg_skew, max(skew) AS max_skew,
         CAST(CASE WHEN count(size_gb) < jobs.num_tables THEN jobs.num_tables * sum(size_gb)
                   ELSE sum(size_gb) FILTER (WHERE pos < jobs.num_tables) END AS DECIMAL(38,4)) AS padded_total_size,
         CASE WHEN count(join_cx) < jobs.num_tables THEN max(join_cx)
              ELSE max(join_cx) FILTER (WHERE pos < jobs.num_tables) END AS padded_max_join,
         CASE WHEN count(xf_cx) < jobs.num_tables THEN max(xf_cx)
              ELSE max(xf_cx) FILTER (WHERE pos < jobs.num_tables) END AS padded_max_xf,
         CASE WHEN count(skew) < jobs.num_tables THEN max(skew)
              ELSE max(skew) FILTER (WHERE pos < jobs.num_tables) END AS padded_max_skew
  FROM jt JOIN jobs ON jt.job_id = jobs.job_id
  GROUP BY jt.job_id, jobs.num_tables, jobs.recency, jobs.frequency, jobs.use_spot, jobs.sla, jobs.auto_terminate,
           jobs.workload_type),
fv AS (
  SELECT *,
         CASE WHEN k_size > 0 THEN CAST((2 * var_num + CAST(k_size AS HUGEINT) * k_size * 1000000)
                                        // (2 * CAST(k_size AS HUGEINT) * k_size * 1000000) AS DECIMAL(38,0)) * 0.01
         END AS var_size,
         var_num > CAST(1000000000000 AS HUGEINT) * k_size * k_size AS var_over_10000
  FROM f),
s AS (
  SELECT *,
    CAST((CASE WHEN num_tables <= 5 THEN 1 WHEN num_tables <= 15 THEN 2 ELSE 0 END)
       + (CASE WHEN avg_size <= 100 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_join >= 4 AND avg_join <= 7 THEN 1 ELSE 0 END) AS INTEGER) AS score_general,
    CAST((CASE WHEN num_tables <= 5 THEN 2 ELSE 0 END)
       + (CASE WHEN avg_size > 500 THEN 2 ELSE 0 END)
       + (CASE WHEN max_size > 1000 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_xf > 7 THEN 2 ELSE 0 END)
       + (CASE WHEN max_xf > 8 THEN 1 ELSE 0 END) AS INTEGER) AS score_ml,
    CAST((CASE WHEN num_tables > 15 THEN 2 ELSE 0 END)
       + (CASE WHEN avg_size <= 100 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_join >= 4 AND avg_join <= 7 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_xf >= 4 AND avg_xf <= 7 THEN 2 ELSE 0 END)
       + (CASE WHEN avg_skew >= 4 AND avg_skew <= 7 THEN 1 ELSE 0 END)
       + (CASE WHEN recency > 7 THEN 2 ELSE 0 END)
       + (CASE WHEN frequency > 7 THEN 2 ELSE 0 END) AS INTEGER) AS score_streaming,
    CAST((CASE WHEN num_tables > 5 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_size > 100 AND avg_size <= 500 THEN 2 ELSE 0 END)
       + (CASE WHEN var_over_10000 THEN 2 ELSE 0 END)
       + (CASE WHEN avg_join > 7 THEN 2 ELSE 0 END)
       + (CASE WHEN max_join > 8 THEN 1 ELSE 0 END)
       + (CASE WHEN avg_skew > 7 THEN 2 ELSE 0 END)
       + (CASE WHEN max_skew > 8 THEN 1 ELSE 0 END)
       + (CASE WHEN recency >= 4 AND recency <= 7 THEN 1 ELSE 0 END)
       + (CASE WHEN frequency >= 4 AND frequency <= 7 THEN 1 ELSE 0 END) AS INTEGER) AS score_caching
  FROM fv),
t0 AS (
  SELECT *,
    CASE WHEN list_sort([score_general, score_ml, score_streaming, score_caching])[4]
              - list_sort([score_general, score_ml, score_streaming, score_caching])[3] > 2
         THEN CASE greatest(score_general, score_ml, score_streaming, score_caching)
                WHEN score_general THEN 'General' WHEN score_ml THEN 'ML/High Memory'
                WHEN score_streaming THEN 'Streaming/ELT' ELSE 'Data Caching/Analysis' END
         ELSE 'General' END AS workload_type
  FROM s),
t AS (
  SELECT *, coalesce(override_type, workload_type) AS sizing_type,
         CASE WHEN least(k_size, k_join, k_xf, k_skew) = 0 THEN 'empty list' ELSE 'ok' END AS status
  FROM t0),
z AS (
  SELECT *, CASE sizing_type WHEN 'ML/High Memory' THEN 'r5.xlarge' WHEN 'Streaming/ELT' THEN 'c5.xlarge'
                 WHEN 'Data Caching/Analysis' THEN 'i3.xlarge' ELSE 'm5.xlarge' END AS instance_type,
         greatest(2, CAST(ceil(padded_total_size / 128) AS BIGINT)) AS cores
  FROM t),
w AS (
  SELECT *, greatest(2, CAST(ceil(cores / 4) AS BIGINT)) AS workers,
         CASE WHEN NOT use_spot THEN 0 WHEN sla THEN 20 ELSE 80 END AS spot_pct
  FROM z),
r AS (
  SELECT *, greatest(1, workers - 2) AS min_instances, workers * 2 AS max_instances,
         CASE WHEN use_spot THEN CAST(floor(workers * spot_pct / 100) AS BIGINT) END AS spot_workers
  FROM w)
"""


_CONF = [
    ("spark.sql.shuffle.partitions", "CAST(cores * 2 AS VARCHAR)"),
    ("spark.sql.adaptive.enabled", "'true'"),
    ("spark.sql.adaptive.coalescePartitions.enabled", "'true'"),
    ("spark.sql.adaptive.skewJoin.enabled", "'true'"),
    ("spark.sql.adaptive.skewJoin.skewedPartitionFactor",
     "CAST(greatest(5, CAST(floor(padded_max_skew) AS BIGINT)) AS VARCHAR)"),
    ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "'268435456'"),
    ("spark.sql.adaptive.localShuffleReader.enabled", "'true'"),
    ("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "'true'"),
]

_ADVICE = """concat_ws(chr(10),
    CASE WHEN use_spot AND NOT sla THEN 'Using spot instances for workers. Consider a mix of on-demand and spot instances for reliability.'
         WHEN sla THEN 'Using on-demand instances due to SLA requirements.' END,
    CASE WHEN auto_terminate THEN 'Enabled auto-termination. Cluster will terminate after 15 minutes of inactivity.' END,
    CASE WHEN padded_max_join > 7 THEN 'Consider using broadcast joins for smaller tables.' END,
    CASE WHEN padded_max_skew > 7 THEN 'High data skew detected. Consider salting keys for better distribution.' END,
    CASE WHEN padded_max_xf > 7 THEN 'Complex transformations detected. Consider caching intermediate results.' END,
    'Configured auto-scaling with min instances: ' || min_instances || ', max instances: ' || max_instances,
    'Scale-out adjustment: +1 instance, Scale-in adjustment: -1 instance',
    'Auto-scaling cooldown period: 300 seconds',
    'Added safeguard to terminate jobs running longer than 6.0 hours')"""

_N_ADVICE = """CAST(4 + (CASE WHEN (use_spot AND NOT sla) OR sla THEN 1 ELSE 0 END)
    + (CASE WHEN auto_terminate THEN 1 ELSE 0 END) + (CASE WHEN padded_max_join > 7 THEN 1 ELSE 0 END)
    + (CASE WHEN padded_max_skew > 7 THEN 1 ELSE 0 END) + (CASE WHEN padded_max_xf > 7 THEN 1 ELSE 0 END)
    AS INTEGER)"""

_NUM_RE = J.NUMBER_RE

SQL = {
    "job_features": _cte(False) + """
SELECT job_id, num_tables, k_size, total_size, avg_size, max_size, CAST(var_size AS DECIMAL(38,2)) AS var_size,
       var_over_10000, avg_join, max_join, avg_xf, max_xf, avg_skew, max_skew FROM fv""",
    "job_scores": _cte(False) + """
SELECT job_id, score_general, score_ml, score_streaming, score_caching FROM s""",
    "workload_type": _cte(False) + "SELECT job_id, workload_type FROM t",
    "job_sizing": _cte(False) + """
SELECT job_id, sizing_type, padded_total_size, cores, instance_type, 4 AS instance_cores,
       16 AS instance_memory_gb, workers, min_instances, max_instances, 1 AS scale_out_step, -1 AS scale_in_step,
       300 AS cooldown_seconds, 21600 AS max_execution_seconds FROM r""",
    "fleet_summary": _cte(False) + """
SELECT sizing_type AS workload_type, count(*) AS n_jobs, CAST(sum(cores) AS BIGINT) AS total_cores
FROM r GROUP BY sizing_type""",
    "job_padded_size": _cte(True) + """
SELECT job_id, num_tables, k_size, padded_total_size, padded_max_join, padded_max_xf, padded_max_skew, cores FROM r""",
    "job_padded_last": _derived_sources(True) + """
p AS (
  SELECT jt.job_id, jobs.num_tables, count(size_gb) AS k_size,
         CAST(CASE WHEN count(size_gb) < jobs.num_tables
                   THEN sum(size_gb) + (jobs.num_tables - count(size_gb)) * arg_max(size_gb, pos)
                   ELSE sum(size_gb) FILTER (WHERE pos < jobs.num_tables) END AS DECIMAL(38,4)) AS padded_total_size
  FROM jt JOIN jobs ON jt.job_id = jobs.job_id
  GROUP BY jt.job_id, jobs.num_tables)
SELECT job_id, num_tables, k_size, padded_total_size FROM p""",
    "job_spot_split": _cte(True) + """
SELECT job_id, use_spot, sla, workers, spot_pct, spot_workers, workers - coalesce(spot_workers, 0) AS on_demand_workers
FROM r""",
    "job_spark_conf": _cte(True) + "\nUNION ALL\n".join(
        f"SELECT job_id, {i} AS conf_pos, '{k}' AS conf_key, {v} AS conf_value FROM r"
        for i, (k, v) in enumerate(_CONF)),
    "job_advice": _cte(True) + f"SELECT job_id, {_N_ADVICE} AS n_advice, {_ADVICE} AS advice_text FROM r",
    "job_text_recommend": _cte(False, _TEXT_SOURCES) + f"""
SELECT job_id, status, CASE WHEN status = 'ok' THEN workload_type END AS computed_type, sizing_type,
       padded_total_size, cores, workers, spot_workers, workers - coalesce(spot_workers, 0) AS on_demand_workers,
       CAST(greatest(5, CAST(floor(padded_max_skew) AS BIGINT)) AS VARCHAR) AS skew_factor,
       {_N_ADVICE} AS n_advice
FROM r""",
    "setting_texts": """
SELECT o_orderkey, CAST(1 AS INTEGER) AS line, 'spark.sql.shuffle.partitions' AS key, CAST(o_orderkey AS VARCHAR) AS value, true AS modifiable FROM orders
UNION ALL SELECT o_orderkey, 3, 'spark.executor.cores', '4', false FROM orders
UNION ALL SELECT o_orderkey, 4, 'spark.sql.warehouse.dir', '/w/' || o_orderstatus, false FROM orders
UNION ALL SELECT o_orderkey, 5, 'spark.sql.adaptive.enabled', 'true', true FROM orders""",
    "job_list_parse": f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         concat_ws(',', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(l_partkey % 100 AS VARCHAR),
                   CASE WHEN l_suppkey % 13 = 0 THEN 'x' ELSE CAST(l_suppkey % 50 AS VARCHAR) END,
                   CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE '7.5' END,
                   CASE WHEN l_orderkey % 7 = 0 THEN '1e2' ELSE '' END) AS list_text
  FROM lineitem),
i AS (
  SELECT *, list_filter(list_transform(string_split(list_text, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM t),
p AS (
  SELECT *, list_bool_or(list_transform(items, lambda x: NOT regexp_full_match(x, '{_NUM_RE}'))) AS bad FROM i),
v AS (
  SELECT *, CASE WHEN bad THEN [1.0::DOUBLE] ELSE list_transform(items, lambda x: CAST(x AS DOUBLE)) END AS vals FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(vals) AS INTEGER) AS n_items,
       coalesce(bad, false) AS is_default, list_sum(vals) AS sum_items, list_max(vals) AS max_item
FROM v""",
    "key_skew_profile": "\nUNION ALL\n".join(f"""
SELECT 'lineitem' AS table_name, '{k}' AS key_column, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
       max(n) AS max_freq,
       CAST(sum(n) AS DOUBLE) / count(*) AS avg_freq,
       CAST(least(10, greatest(1, round(max(n) / (CAST(sum(n) AS DOUBLE) / count(*))))) AS INTEGER) AS skew
FROM (SELECT {k}, count(*) AS n FROM lineitem GROUP BY {k})""" for k in ("l_suppkey", "l_partkey", "l_orderkey")),
    "column_profile": "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, (SELECT count(*) FROM lineitem) AS n_rows
FROM (SELECT *, year(l_shipdate) AS l_shipyear FROM lineitem) GROUP BY {c} HAVING count(*) >= 0.05 * (SELECT count(*) FROM lineitem)""" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate", "l_shipyear")),
    "cached_branches": """
SELECT 'brand' AS branch, p_brand AS grp, count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
UNION ALL
SELECT 'returnflag' AS branch, l_returnflag AS grp, count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""",
}
