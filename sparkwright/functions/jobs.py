"""Job-fleet analytics (K1-K13): classify and size a whole table of job descriptors in one Spark job.

Model (long form, so that the list statistics are plain group aggregates):

* ``jobs(job_id, num_tables, recency, frequency, use_spot, sla, auto_terminate, workload_type)`` - one row
  per job; ``workload_type`` is an optional user override (null = use the computed type).
* ``job_tables(job_id, pos, size_gb, join_cx, xf_cx, skew)`` - one row per list position; the four lists may
  have different lengths, so a null in a column means that list has ended (each list is counted on its own).

Plan: ``job_tables`` is joined to ``jobs`` on ``job_id`` (an inner join, so AQE may split a job with a huge
list), aggregated once per job on the same partitioning (no second shuffle), and brought back to every job
with a left join that keeps jobs whose lists are empty. Everything after that is row-local expressions:
scores, type, sizing, settings and advice are columns, not Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# Fixed values. These must equal the reference's so that labels, sizes, settings and advice texts match.
# ---------------------------------------------------------------------------------------------------------
GENERAL = "General"
ML = "ML/High Memory"
STREAMING = "Streaming/ELT"
CACHING = "Data Caching/Analysis"
LABELS = (GENERAL, ML, STREAMING, CACHING)          # tie order of the reference's choice
INSTANCE_TYPE = {ML: "r5.xlarge", STREAMING: "c5.xlarge", CACHING: "i3.xlarge", GENERAL: "m5.xlarge"}
GB_PER_CORE = 128              # sizes are divided by this number to get cores
INSTANCE_CORES = 4
INSTANCE_MEMORY_GB = 16
MIN_CORES = 2
MIN_WORKERS = 2
SPOT_PCT_NO_SLA = 80
SPOT_PCT_SLA = 20
SCALE_OUT_STEP = 1
SCALE_IN_STEP = -1
COOLDOWN_SECONDS = 300
MAX_EXECUTION_SECONDS = 6 * 60 * 60
DEFAULT_LIST_ITEM = 1.0        # the whole list becomes [1.0] when any item is not a number
SKEW_FACTOR_FLOOR = 5
SKEW_THRESHOLD_BYTES = 268435456
ADVICE_SPOT = "Using spot instances for workers. Consider a mix of on-demand and spot instances for reliability."
ADVICE_SLA = "Using on-demand instances due to SLA requirements."
ADVICE_AUTO_TERMINATE = "Enabled auto-termination. Cluster will terminate after 15 minutes of inactivity."
ADVICE_BROADCAST = "Consider using broadcast joins for smaller tables."
ADVICE_SALT = "High data skew detected. Consider salting keys for better distribution."
ADVICE_CACHE = "Complex transformations detected. Consider caching intermediate results."
ADVICE_AUTOSCALE = "Configured auto-scaling with min instances: %d, max instances: %d"
ADVICE_STEPS = "Scale-out adjustment: +1 instance, Scale-in adjustment: -1 instance"
ADVICE_COOLDOWN = "Auto-scaling cooldown period: 300 seconds"
ADVICE_SAFEGUARD = "Added safeguard to terminate jobs running longer than 6.0 hours"
CONF_KEYS = (
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
    "spark.sql.adaptive.localShuffleReader.enabled",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled",
)
# ---------------------------------------------------------------------------------------------------------

# A number as the list parser accepts it: optional sign, digits with an optional fraction (or a bare
# fraction), optional exponent. Underscores, "inf", "nan" and suffixes count as bad items.
NUMBER = r"[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMBER_RE = rf"^{NUMBER}$"
# A whole list is good when every comma-separated item is blank or a number (whitespace around items allowed).
GOOD_LIST_RE = rf"^\s*(?:{NUMBER}\s*)?(?:,\s*(?:{NUMBER}\s*)?)*$"   # unambiguous: no backtracking blow-up

# Sizes keep ten decimals and eighteen digits before the point; a sum of 1e10 of them still fits decimal(38,10).
SIZE = "decimal(28,10)"


# ---------------------------------------------------------------------------------------------------------
# K1: list parsing
# ---------------------------------------------------------------------------------------------------------

def list_has_bad_item(text: Column) -> Column:
    """True when some non-blank item of the comma text is not a number (one regex, no per-item lambda)."""
    return ~F.coalesce(text, F.lit("")).rlike(GOOD_LIST_RE)


def parse_number_list(text: Column) -> Column:
    """Comma text -> ``array<double>``: split, trim, drop blanks; if any item is not a number the whole list
    becomes ``[1.0]``. Blank text gives an empty array.

    Built from native expressions only (regex check, split, ``array_remove``, array cast), so it stays in
    whole-stage codegen instead of evaluating a lambda per item.
    """
    t = F.coalesce(text, F.lit(""))
    # outer whitespace off, then split on commas with their surrounding whitespace: blank items become ""
    items = F.array_remove(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s*,\s*"), "")
    return F.when(list_has_bad_item(t), F.array(F.lit(DEFAULT_LIST_ITEM))).otherwise(
        items.cast("array<double>"))


def lists_to_long(jobs_text: DataFrame, id_col: str = "job_id",
                  columns: dict[str, str] | None = None) -> DataFrame:
    """Comma-text descriptor columns -> ``job_tables`` long form, one row per list position.

    ``columns`` maps text column -> long-form column (default: table_sizes, join_complexities,
    transformation_complexities, data_skews). Positions beyond a list's end are null. The explode is
    row-local: no shuffle.
    """
    columns = columns or {"table_sizes": "size_gb", "join_complexities": "join_cx",
                          "transformation_complexities": "xf_cx", "data_skews": "skew"}
    parsed = jobs_text.select(F.col(id_col).alias("job_id"),
                              *[parse_number_list(F.col(t)).alias(o) for t, o in columns.items()])
    outs = list(columns.values())
    longest = F.greatest(*[F.size(F.col(o)) for o in outs])
    rows = parsed.select("job_id", *outs, F.explode(F.sequence(F.lit(0), longest - 1)).alias("pos"))
    rows = rows.where(longest > 0)
    return rows.select("job_id", F.col("pos").cast("int").alias("pos"), *[
        (F.try_element_at(F.col(o), F.col("pos") + 1).cast(SIZE) if o == "size_gb"
         else F.try_element_at(F.col(o), F.col("pos") + 1)).alias(o) for o in outs])


# ---------------------------------------------------------------------------------------------------------
# K2 + K5: one aggregate per job
# ---------------------------------------------------------------------------------------------------------

def _padded_sum(col: str, n: Column, k: Column, pad: str = "repeat") -> Column:
    """Sum of the list padded or cut to n items (K5). The reference repeats the whole list n times when it
    is shorter (``pad="repeat"``, the default). ``pad="last"`` instead extends it with its last item. A list
    at least n long keeps its first n items."""
    if pad == "last":
        short = F.sum(col) + (n - k).cast("decimal(10,0)") * F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("pos")))
    else:
        short = n.cast("decimal(10,0)") * F.sum(col)
    return F.when(k < n, short).otherwise(F.sum(F.when(F.col("pos") < n, F.col(col))))


def _padded_max(col: str, n: Column, k: Column) -> Column:
    # repeating the list or its last item never raises the maximum
    return F.when(k < n, F.max(col)).otherwise(F.max(F.when(F.col("pos") < n, F.col(col))))


def job_features(jobs: DataFrame, job_tables: DataFrame, pad: str = "repeat") -> DataFrame:
    """Per job: list statistics as given (K2) and after padding to ``num_tables`` (K5).

    Size sums are exact decimals. The population variance is computed in doubles, as its squares have no bound
    that a decimal could hold; the rule ``var_pop(size) > 10000`` is evaluated on it.
    """
    jt = job_tables.select("job_id", "pos", F.col("size_gb").cast(SIZE).alias("size_gb"),
                           F.col("join_cx").cast("double").alias("join_cx"),
                           F.col("xf_cx").cast("double").alias("xf_cx"),
                           F.col("skew").cast("double").alias("skew"))
    n = F.col("num_tables")
    ks, kj, kx, kk = (F.count(c) for c in ("size_gb", "join_cx", "xf_cx", "skew"))
    agg = (jt.join(jobs.select("job_id", "num_tables"), "job_id", "inner")
           .groupBy("job_id", "num_tables")
           .agg(ks.alias("k_size"), kj.alias("k_join"), kx.alias("k_xf"), kk.alias("k_skew"),
                F.sum("size_gb").cast("decimal(38,10)").alias("total_size"),
                F.avg("size_gb").cast("decimal(38,10)").alias("avg_size"),
                F.max("size_gb").alias("max_size"),
                F.var_pop(F.col("size_gb").cast("double")).alias("_var"),
                F.avg("join_cx").alias("avg_join"), F.max("join_cx").alias("max_join"),
                F.avg("xf_cx").alias("avg_xf"), F.max("xf_cx").alias("max_xf"),
                F.avg("skew").alias("avg_skew"), F.max("skew").alias("max_skew"),
                _padded_sum("size_gb", n, ks, pad).cast("decimal(38,10)").alias("padded_total_size"),
                _padded_max("join_cx", n, kj).alias("padded_max_join"),
                _padded_max("xf_cx", n, kx).alias("padded_max_xf"),
                _padded_max("skew", n, kk).alias("padded_max_skew"))
           .drop("num_tables"))
    agg = (agg.withColumn("var_size", F.col("_var").try_cast("decimal(38,2)")).withColumn("var_over_10000", F.col("_var") > 10000)
              .drop("_var"))
    out = jobs.join(agg, "job_id", "left")
    counts = ["k_size", "k_join", "k_xf", "k_skew"]
    return out.fillna(0, subset=counts).withColumn(
        "status", F.when(F.least(*[F.col(c) for c in counts]) == 0, F.lit("empty list")).otherwise(F.lit("ok")))


def _listed(values: Column, start: Column) -> Column:
    """Sum of an array, null when it is empty (as SQL sums are)."""
    return F.when(F.size(values) > 0, F.aggregate(values, start, lambda acc, x: acc + x))


def job_features_from_lists(jobs: DataFrame, lists: dict[str, str], pad: str = "repeat") -> DataFrame:
    """The columns of ``job_features`` for jobs that hold their lists as arrays: array column -> size_gb, join_cx,
    xf_cx or skew. Every feature is worked out within the row, so nothing is exploded, shuffled or joined."""
    column = {of: name for name, of in lists.items()}
    n = F.col("num_tables")
    kept = jobs.withColumn(column["size_gb"], F.transform(column["size_gb"], lambda x: x.cast(SIZE)))
    size, others = F.col(column["size_gb"]), {"join": "join_cx", "xf": "xf_cx", "skew": "skew"}
    zero, count = F.lit(0).cast("decimal(37,10)"), F.size(size).cast("decimal(10,0)")
    total = lambda values: F.when(F.size(values) > 0, F.aggregate(
        values, zero, lambda acc, x: (acc + x).cast("decimal(37,10)"))).cast("decimal(38,10)")
    first = lambda values: F.slice(values, 1, F.greatest(n, F.lit(0)))
    kept = kept.withColumns({"k_size": F.size(size).cast("bigint"), "total_size": total(size),
                             **{f"k_{o}": F.size(column[c]).cast("bigint") for o, c in others.items()}})
    mean = F.col("total_size").cast("double") / F.col("k_size")
    spread = _listed(F.transform(size, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean)), F.lit(0.0))
    extended = (F.col("total_size") + (n - F.col("k_size")).cast("decimal(10,0)") * F.try_element_at(size, F.lit(-1))
                if pad == "last" else n.cast("decimal(10,0)") * F.col("total_size"))
    padded = F.when(F.col("k_size") < n, extended).otherwise(total(first(size)))
    out = kept.withColumns({
        "avg_size": (F.col("total_size") / F.when(count > 0, count)).cast("decimal(38,10)"), "max_size": F.array_max(size),
        "_var": spread / F.col("k_size"),
        **{f"avg_{o}": _listed(F.col(column[c]), F.lit(0.0)) / F.col(f"k_{o}") for o, c in others.items()},
        **{f"max_{o}": F.array_max(column[c]) for o, c in others.items()},
        "padded_total_size": padded.cast("decimal(38,10)"),
        **{f"padded_max_{o}": F.when(F.col(f"k_{o}") < n, F.array_max(column[c])).otherwise(F.array_max(first(F.col(column[c]))))
           for o, c in others.items()}})
    counts = [F.col(f"k_{o}") for o in ("size", *others)]
    out = out.withColumns({"var_size": F.col("_var").try_cast("decimal(38,2)"), "var_over_10000": F.col("_var") > 10000,
                           "status": F.when(F.least(*counts) == 0, F.lit("empty list")).otherwise(F.lit("ok"))})
    names = ("k_size k_join k_xf k_skew total_size avg_size max_size avg_join max_join avg_xf max_xf avg_skew max_skew "
             "padded_total_size padded_max_join padded_max_xf padded_max_skew var_size var_over_10000 status").split()
    return out.select(*[c for c in jobs.columns if c not in lists], *names)


# ---------------------------------------------------------------------------------------------------------
# K3 + K4: scores and workload type
# ---------------------------------------------------------------------------------------------------------

def _pts(cond: Column, points: int) -> Column:
    return F.when(cond, F.lit(points)).otherwise(F.lit(0))


def _between(c: Column, lo: float, hi: float) -> Column:
    return (c >= lo) & (c <= hi)


def score_columns(f: DataFrame) -> DataFrame:
    """Four integer scores from the rules (K3); the features are the lists as given."""
    n, avg_s, max_s = F.col("num_tables"), F.col("avg_size"), F.col("max_size")
    avg_j, max_j = F.col("avg_join"), F.col("max_join")
    avg_x, max_x = F.col("avg_xf"), F.col("max_xf")
    avg_k, max_k = F.col("avg_skew"), F.col("max_skew")
    rec, freq = F.col("recency"), F.col("frequency")
    few, mid, many = n <= 5, (n > 5) & (n <= 15), n > 15
    big, medium, small = avg_s > 500, (avg_s > 100) & (avg_s <= 500), avg_s <= 100

    general = (_pts(few, 1) + _pts(mid, 2) + _pts(small, 1) + _pts(_between(avg_j, 4, 7), 1))
    ml = (_pts(few, 2) + _pts(big, 2) + _pts(max_s > 1000, 1) + _pts(avg_x > 7, 2) + _pts(max_x > 8, 1))
    streaming = (_pts(many, 2) + _pts(small, 1) + _pts(_between(avg_j, 4, 7), 1) + _pts(_between(avg_x, 4, 7), 2)
                 + _pts(_between(avg_k, 4, 7), 1) + _pts(rec > 7, 2) + _pts(freq > 7, 2))
    caching = (_pts(mid, 1) + _pts(many, 1) + _pts(medium, 2) + _pts(F.col("var_over_10000"), 2)
               + _pts(avg_j > 7, 2) + _pts(max_j > 8, 1) + _pts(avg_k > 7, 2) + _pts(max_k > 8, 1)
               + _pts(_between(rec, 4, 7), 1) + _pts(_between(freq, 4, 7), 1))
    ok = F.col("status") == "ok"
    return f.select("*", *[F.when(ok, s).cast("int").alias(name) for name, s in
                           (("score_general", general), ("score_ml", ml),
                            ("score_streaming", streaming), ("score_caching", caching))])


def workload_type_column() -> Column:
    """Best label if it beats the runner-up by more than 2, else General (K4). Null for empty lists."""
    s = [F.col("score_general"), F.col("score_ml"), F.col("score_streaming"), F.col("score_caching")]
    ranked = F.sort_array(F.array(*s))
    top, second = F.element_at(ranked, 4), F.element_at(ranked, 3)
    best = (F.when(s[0] == top, F.lit(GENERAL)).when(s[1] == top, F.lit(ML))
             .when(s[2] == top, F.lit(STREAMING)).otherwise(F.lit(CACHING)))
    return F.when(F.col("status") != "ok", F.lit(None).cast("string")) \
            .when(top - second > 2, best).otherwise(F.lit(GENERAL))


def classify_jobs(jobs: DataFrame, job_tables: DataFrame, pad: str = "repeat") -> DataFrame:
    """Features, scores and ``computed_type`` for every job."""
    return score_columns(job_features(jobs, job_tables, pad)).withColumn("computed_type", workload_type_column())


# ---------------------------------------------------------------------------------------------------------
# Sizing, spot split, autoscaling, settings, advice
# ---------------------------------------------------------------------------------------------------------

def sizing_columns(c: DataFrame, gb_per_core: int = GB_PER_CORE) -> DataFrame:
    """Cores, instance family, workers, spot split and autoscale bounds from the padded lists.

    The type used for sizing is the user's override when given, else the computed one.
    """
    wtype = F.coalesce(F.col("workload_type"), F.col("computed_type"))
    total = F.col("padded_total_size")
    # exact ceiling: the whole quotient, and one more if a remainder is left
    left = total % F.lit(gb_per_core)
    whole = ((total - left) / F.lit(gb_per_core)).cast("bigint")
    whole = F.when(left > 0, whole + 1).otherwise(whole)
    cores = F.greatest(F.lit(MIN_CORES), whole)
    workers = F.greatest(F.lit(MIN_WORKERS), F.ceil(F.col("cores") / F.lit(INSTANCE_CORES)).cast("bigint"))
    spot_pct = (F.when(~F.col("use_spot"), F.lit(0))
                 .when(F.col("sla"), F.lit(SPOT_PCT_SLA)).otherwise(F.lit(SPOT_PCT_NO_SLA)))
    spot = F.when(F.col("use_spot"), F.floor(F.col("workers") * F.col("spot_pct") / F.lit(100)).cast("bigint"))
    instance = (F.when(wtype == ML, F.lit(INSTANCE_TYPE[ML]))
                 .when(wtype == STREAMING, F.lit(INSTANCE_TYPE[STREAMING]))
                 .when(wtype == CACHING, F.lit(INSTANCE_TYPE[CACHING]))
                 .otherwise(F.lit(INSTANCE_TYPE[GENERAL])))
    return (c.withColumn("sizing_type", wtype)
             .withColumn("cores", cores)
             .withColumn("instance_type", instance)
             .withColumn("instance_cores", F.lit(INSTANCE_CORES))
             .withColumn("instance_memory_gb", F.lit(INSTANCE_MEMORY_GB))
             .withColumn("workers", workers)
             .withColumn("spot_pct", spot_pct)
             .withColumn("spot_workers", spot)
             .withColumn("on_demand_workers", F.col("workers") - F.coalesce(F.col("spot_workers"), F.lit(0)))
             .withColumn("min_instances", F.greatest(F.lit(1), F.col("workers") - 2))
             .withColumn("max_instances", F.col("workers") * 2)
             .withColumn("scale_out_step", F.lit(SCALE_OUT_STEP))
             .withColumn("scale_in_step", F.lit(SCALE_IN_STEP))
             .withColumn("cooldown_seconds", F.lit(COOLDOWN_SECONDS))
             .withColumn("max_execution_seconds", F.lit(MAX_EXECUTION_SECONDS)))


def skew_factor() -> Column:
    return F.greatest(F.lit(SKEW_FACTOR_FLOOR), F.floor(F.col("padded_max_skew")).cast("bigint"))


def spark_conf_column() -> Column:
    """The eight settings as ``map<string,string>``."""
    values = [(F.col("cores") * 2).cast("string"), F.lit("true"), F.lit("true"), F.lit("true"),
              skew_factor().cast("string"), F.lit(str(SKEW_THRESHOLD_BYTES)), F.lit("true"), F.lit("true")]
    return F.map_from_arrays(F.array(*[F.lit(k) for k in CONF_KEYS]), F.array(*values))


def advice_column() -> Column:
    """Advice lines in the reference's order (K12); null entries are dropped."""
    spot, sla = F.col("use_spot"), F.col("sla")
    autoscale = F.format_string(ADVICE_AUTOSCALE, F.col("min_instances"), F.col("max_instances"))
    return F.array_compact(F.array(
        F.when(spot & ~sla, F.lit(ADVICE_SPOT)).when(sla, F.lit(ADVICE_SLA)),
        F.when(F.col("auto_terminate"), F.lit(ADVICE_AUTO_TERMINATE)),
        F.when(F.col("padded_max_join") > 7, F.lit(ADVICE_BROADCAST)),
        F.when(F.col("padded_max_skew") > 7, F.lit(ADVICE_SALT)),
        F.when(F.col("padded_max_xf") > 7, F.lit(ADVICE_CACHE)),
        autoscale, F.lit(ADVICE_STEPS), F.lit(ADVICE_COOLDOWN), F.lit(ADVICE_SAFEGUARD)))


def recommend(jobs: DataFrame, job_tables: DataFrame, gb_per_core: int = GB_PER_CORE,
              pad: str = "repeat") -> DataFrame:
    """Everything per job: features, scores, type, sizing, settings map and advice list."""
    if pad not in ("repeat", "last"):
        raise ValueError("pad must be 'repeat' or 'last'")
    return _recommended(job_features(jobs, job_tables, pad), gb_per_core)


def _recommended(features: DataFrame, gb_per_core: int) -> DataFrame:
    c = sizing_columns(score_columns(features).withColumn("computed_type", workload_type_column()), gb_per_core)
    return c.withColumn("spark_conf", spark_conf_column()).withColumn("advice", advice_column())


TEXT_LISTS = {"table_sizes": "size_gb", "join_complexities": "join_cx",
              "transformation_complexities": "xf_cx", "data_skews": "skew"}


def recommend_from_text(descriptors: DataFrame, gb_per_core: int = GB_PER_CORE, pad: str = "repeat") -> DataFrame:
    """Recommendations for job descriptors as the form takes them: ``job_id, num_tables``, the four lists as
    comma text, ``use_spot_instances, sla_requirements, enable_auto_termination, recency, frequency`` and
    an optional ``workload_type`` override. A row has all that its job needs, so the lists stay arrays and the
    plan is row-local: no explode, shuffle or join. Rows that repeat a job_id are jobs of their own."""
    if pad not in ("repeat", "last"):
        raise ValueError("pad must be 'repeat' or 'last'")
    cols = set(descriptors.columns)
    jobs = descriptors.select(
        "job_id", F.col("num_tables").cast("int").alias("num_tables"),
        F.col("recency").cast("int").alias("recency"), F.col("frequency").cast("int").alias("frequency"),
        F.coalesce(F.col("use_spot_instances"), F.lit(False)).alias("use_spot"),
        F.coalesce(F.col("sla_requirements"), F.lit(False)).alias("sla"),
        F.coalesce(F.col("enable_auto_termination"), F.lit(False)).alias("auto_terminate"),
        (F.col("workload_type") if "workload_type" in cols else F.lit(None)).cast("string").alias("workload_type"),
        *[parse_number_list(F.col(t)).alias(t) for t in TEXT_LISTS])
    return _recommended(job_features_from_lists(jobs, TEXT_LISTS, pad), gb_per_core)


def settings_lines(rec: DataFrame, job_id) -> list[str]:
    """One job's eight settings as ``key = value`` lines, ready for ``functions.conf.apply_settings`` or a
    spec's ``settings``. Only that job's map (eight entries) reaches the driver."""
    row = rec.filter(F.col("job_id") == F.lit(job_id)).select("spark_conf").first()
    if row is None:
        raise KeyError(f"no job {job_id!r}")
    return [f"{k} = {row.spark_conf[k]}" for k in CONF_KEYS]


def fleet_summary(rec: DataFrame) -> DataFrame:
    """Jobs and cores per sizing type (K13): a two-phase aggregate over four keys at most."""
    return rec.groupBy(F.col("sizing_type").alias("workload_type")).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.sum("cores").cast("bigint").alias("total_cores"))


def conf_rows(rec: DataFrame) -> DataFrame:
    """One row per (job, setting), in the reference's order."""
    return rec.select("job_id", F.posexplode(F.col("spark_conf")).alias("conf_pos", "conf_key", "conf_value")) \
              .withColumn("conf_pos", F.col("conf_pos").cast("int"))
