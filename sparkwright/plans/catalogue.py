"""The query catalogue: one function per operator query, each ``(spark, sf_dir) -> DataFrame``.

Relational queries are written the way a user of this library writes them: as a job spec run by
:func:`run_job` against the parquet tables of ``sf_dir``. Computed columns carry the same names as in the SQL
of :mod:`.oracle`, and types are cast where Spark and DuckDB would differ (counts to bigint, money sums to
decimal(38,2), ``year()`` to int).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import salted_outer_join
from ..sources.sinks import preview as preview_rows
from ..sources.tables import parquet_dir_resolver
from .run import build_frame, run_job


def _run(spark: SparkSession, sf_dir: str, spec: dict) -> DataFrame:
    return run_job(spark, spec, resolver=parquet_dir_resolver(sf_dir))


def _t(name: str, alias: str | None = None, predicate: str | None = None) -> dict:
    return {"name": name, "alias": alias or name, "predicate": predicate}


def _sel(*pairs: tuple[str, str]) -> list[dict]:
    return [{"output_column": o, "expression": e} for o, e in pairs]


# ---------------------------------------------------------------------------------------------------------
# scans, projections, expressions
# ---------------------------------------------------------------------------------------------------------

def scan_filter(spark, sf_dir):
    """One table, a predicate pushed into the Parquet scan."""
    return _run(spark, sf_dir, {"tables": [_t("lineitem", "l", "l_quantity > 45 AND l_returnflag <> 'N'")]})


def preview(spark, sf_dir):
    """The first 20 rows in key order (a top-k, not a full sort)."""
    df = build_frame(spark, {"tables": [_t("orders", "o")]}, resolver=parquet_dir_resolver(sf_dir))
    return preview_rows(df, 20, order_by=["o_orderkey"])


def project_case(spark, sf_dir):
    """select list with a searched CASE, a string function and year()."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": _sel(
            ("o_orderkey", "o.o_orderkey"),
            ("price_band", "CASE WHEN o.o_totalprice > 300000 THEN 'high' "
                           "WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END"),
            ("status_upper", "upper(o.o_orderstatus)"),
            ("order_year", "CAST(year(o.o_orderdate) AS INT)")),
    })


def add_columns(spark, sf_dir):
    """added columns; the second names the first."""
    return _run(spark, sf_dir, {
        "tables": [_t("lineitem", "l")],
        "transformations": [
            {"kind": "column", "output_column": "net", "expression": "l_extendedprice * (1 - l_discount)"},
            {"kind": "column", "output_column": "gross", "expression": "net * (1 + l_tax)"},
        ],
    })


def scalar_string(spark, sf_dir):
    """F8 (strings): builtin string functions by text."""
    return _run(spark, sf_dir, {
        "tables": [_t("part", "p", "p_name LIKE '%widget%'")],
        "transformations": _sel(
            ("p_partkey", "p_partkey"),
            ("name_upper", "upper(p_name)"),
            ("name_len", "CAST(length(p_name) AS INT)"),
            ("brand_head", "substr(p_brand, 1, 5)"),
            ("label", "concat(p_brand, '-', p_type)"),
            ("name_snake", "replace(p_name, ' ', '_')"),
            ("size_padded", "lpad(CAST(p_size AS STRING), 3, '0')"),
            ("first_word", "split_part(p_name, ' ', 1)")),
    })


def scalar_date(spark, sf_dir):
    """F8 (dates): builtin date functions by text on timestamp_ntz."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": _sel(
            ("o_orderkey", "o_orderkey"),
            ("order_date", "CAST(o_orderdate AS DATE)"),
            ("order_year", "CAST(year(o_orderdate) AS INT)"),
            ("order_month", "CAST(month(o_orderdate) AS INT)"),
            ("order_quarter", "CAST(quarter(o_orderdate) AS INT)"),
            ("month_start", "CAST(date_trunc('MONTH', o_orderdate) AS DATE)"),
            ("due_date", "date_add(CAST(o_orderdate AS DATE), 30)"),
            ("days_to_2000", "CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INT)"),
            ("year_month", "date_format(o_orderdate, 'yyyy-MM')")),
    })


def scalar_math(spark, sf_dir):
    """F8 (math): abs, floor, ceil, sqrt, mod, sign, least/greatest."""
    return _run(spark, sf_dir, {
        "tables": [_t("supplier", "s")],
        "transformations": _sel(
            ("s_suppkey", "s_suppkey"),
            ("abs_bal", "abs(s_acctbal)"),
            ("floor_bal", "CAST(floor(s_acctbal) AS BIGINT)"),
            ("ceil_bal", "CAST(ceil(s_acctbal) AS BIGINT)"),
            ("sqrt_bal", "sqrt(abs(s_acctbal))"),
            ("key_mod_7", "s_suppkey % 7"),
            ("sign_bal", "CAST(sign(s_acctbal) AS INT)"),
            ("capped_bal", "least(greatest(s_acctbal, 0.0), 5000.0)")),
    })


def scalar_json(spark, sf_dir):
    """F8 (JSON): a key of the events' JSON text."""
    return _run(spark, sf_dir, {
        "tables": [_t("events", "e")],
        "transformations": _sel(
            ("event_id", "event_id"),
            ("k", "CAST(get_json_object(props, '$.k') AS INT)"),
            ("has_k", "get_json_object(props, '$.k') IS NOT NULL")),
    })


def scalar_array(spark, sf_dir):
    """F8 (arrays): size and items of the embedding arrays."""
    return _run(spark, sf_dir, {
        "tables": [_t("embeddings", "v")],
        "transformations": _sel(
            ("vec_id", "vec_id"),
            ("dim", "CAST(size(embedding) AS INT)"),
            ("first_item", "CAST(element_at(embedding, 1) AS DOUBLE)"),
            ("max_item", "CAST(array_max(embedding) AS DOUBLE)"),
            ("min_item", "CAST(array_min(embedding) AS DOUBLE)"),
            ("label", "label")),
    })


def scalar_variant(spark, sf_dir):
    """F8 (VARIANT): JSON text parsed once into a variant, typed access by path, and its fields as rows."""
    v = "parse_json(e.props)"
    return _run(spark, sf_dir, {
        "tables": [_t("events", "e")],
        "joins": [{"type": "subquery", "right_alias": "f", "conditions": "e.event_id = f.of_event",
                   "subquery": "SELECT event_id AS of_event, x.pos, x.key, CAST(x.value AS INT) AS item FROM {e}, LATERAL variant_explode(parse_json(props)) AS x"}],
        "transformations": _sel(
            ("event_id", "e.event_id"),
            ("k", f"variant_get({v}, '$.k', 'int')"),
            ("k_text", f"variant_get({v}, '$.k', 'string')"),
            ("nothing", f"try_variant_get({v}, '$.nothing', 'int')"),
            ("is_object", f"schema_of_variant({v}) LIKE 'OBJECT<%'"),
            ("compact", f"to_json({v})"),
            ("field", "f.key"), ("field_pos", "CAST(f.pos AS INT)"), ("field_value", "f.item")),
    })


def scalar_map(spark, sf_dir):
    """F8 (maps): built, filtered, transformed, zipped and joined maps."""
    props = "from_json(props, 'map<string,int>')"
    made = "map_from_arrays(array('k', 'v', 'e'), array(coalesce(element_at(from_json(props, 'map<string,int>'), 'k'), 0), CAST(floor(value) AS INT), CAST(event_id % 100 AS INT)))"
    return _run(spark, sf_dir, {
        "tables": [_t("events", "e")],
        "transformations": _sel(
            ("event_id", "event_id"),
            ("n_big", f"CAST(size(map_filter({made}, (n, x) -> x > 50)) AS INT)"),
            ("big_names", f"array_join(array_sort(map_keys(map_filter({made}, (n, x) -> x > 50))), ',')"),
            ("k_doubled", f"element_at(transform_values({props}, (n, x) -> x * 2), 'k')"),
            ("renamed", f"array_join(map_keys(transform_keys({props}, (n, x) -> concat(n, '_old'))), ',')"),
            ("zipped", f"element_at(map_zip_with({made}, {props}, (n, a, b) -> a + coalesce(b, 0)), 'k')"),
            ("n_joined", f"CAST(size(map_concat({props}, map('one', 1, 'two', 2))) AS INT)"),
            ("has_k", f"map_contains_key({props}, 'k')"),
            ("sum_items", f"aggregate(map_values({made}), 0, (a, x) -> a + x)")),
    })


def scalar_conditional(spark, sf_dir):
    """F8 (conditionals): null handling, choices and comparisons across columns."""
    return _run(spark, sf_dir, {
        "tables": [_t("lineitem", "l")],
        "transformations": _sel(
            ("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey"),
            ("no_zero_tax", "nullif(l_tax, 0.0D)"),
            ("tax_or_discount", "coalesce(nullif(l_tax, 0.0D), nullif(l_discount, 0.0D), -1.0D)"),
            ("has_tax", "nvl2(nullif(l_tax, 0.0D), 'taxed', 'free')"),
            ("larger_rate", "greatest(l_tax, l_discount)"), ("smaller_rate", "least(l_tax, l_discount)"),
            ("flag_name", "decode(l_returnflag, 'R', 'returned', 'A', 'accepted', 'open')"),
            ("size_class", "if(l_quantity >= 25, 'large', if(l_quantity >= 10, 'middle', 'small'))"),
            ("price_per_rate", "try_divide(l_extendedprice, nullif(l_discount, 0.0D))"),
            ("same_rates", "l_tax <=> l_discount")),
    })


# ---------------------------------------------------------------------------------------------------------
# joins
# ---------------------------------------------------------------------------------------------------------

def _inner_join_spec(strategy: str | None = None) -> dict:
    return {
        "tables": [_t("orders", "o"), _t("customer", "c", "c_mktsegment = 'BUILDING'")],
        "joins": [{"type": "inner", "right_table": "c", "conditions": "o.o_custkey == c.c_custkey",
                   "strategy": strategy}],
        "transformations": _sel(("o_orderkey", "o.o_orderkey"), ("c_name", "c.c_name")),
    }


def inner_join(spark, sf_dir):
    """Inner join on alias-qualified text ('==' accepted)."""
    return _run(spark, sf_dir, _inner_join_spec())


def broadcast_join(spark, sf_dir):
    """The inner join with the right side broadcast after a measured bound."""
    return _run(spark, sf_dir, _inner_join_spec("broadcast"))


def _outer_pair(kind: str) -> dict:
    tables = [_t("customer", "c"), _t("orders", "o", "o_totalprice > 300000")]
    if kind == "right":
        tables = tables[::-1]
        join = {"type": "right", "right_table": "c", "conditions": "c.c_custkey = o.o_custkey"}
    else:
        join = {"type": "left", "right_table": "o", "conditions": "c.c_custkey = o.o_custkey"}
    return {"tables": tables, "joins": [join],
            "transformations": _sel(("c_custkey", "c.c_custkey"), ("c_name", "c.c_name"),
                                    ("o_orderkey", "o.o_orderkey"), ("o_totalprice", "o.o_totalprice"))}


def left_join(spark, sf_dir):
    """Left outer join; the filter on orders creates misses."""
    return _run(spark, sf_dir, _outer_pair("left"))


def right_join(spark, sf_dir):
    """Right outer join, same pair as left_join."""
    return _run(spark, sf_dir, _outer_pair("right"))


def full_join(spark, sf_dir):
    """Full outer join on nation."""
    return _run(spark, sf_dir, {
        "tables": [_t("supplier", "s", "s_nationkey < 15"),
                   _t("customer", "c", "c_nationkey >= 10 AND c_acctbal > 9000")],
        "joins": [{"type": "full", "right_table": "c", "conditions": "s.s_nationkey = c.c_nationkey"}],
        "transformations": _sel(("s_suppkey", "s.s_suppkey"), ("s_nationkey", "s.s_nationkey"),
                                ("c_custkey", "c.c_custkey"), ("c_nationkey", "c.c_nationkey")),
    })


def self_join(spark, sf_dir):
    """The chain joined with itself under two new aliases. Each supplier meets the supplier with
    the next key (one partner at most), not every supplier of its nation, so a large nation cannot turn
    into all of its pairs."""
    return _run(spark, sf_dir, {
        "tables": [_t("supplier", "s")],
        "joins": [{"type": "self", "left_alias": "l", "right_alias": "r",
                   "conditions": "r.s_suppkey = l.s_suppkey + 1"}],
        "transformations": _sel(("left_key", "l.s_suppkey"), ("right_key", "r.s_suppkey"),
                                ("same_nation", "l.s_nationkey = r.s_nationkey")),
    })


def subquery_join(spark, sf_dir):
    """Join with a grouped subquery that reads the filtered alias frame."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c"), _t("orders", "o")],
        "joins": [{"type": "subquery", "right_alias": "oc", "conditions": "c.c_custkey = oc.o_custkey",
                   "subquery": "SELECT o_custkey, count(*) AS n_orders FROM {o} GROUP BY o_custkey"}],
        "transformations": _sel(("c_custkey", "c.c_custkey"), ("c_name", "c.c_name"),
                                ("n_orders", "oc.n_orders")),
    })


def subquery_union(spark, sf_dir):
    """Join with a UNION subquery."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c"), _t("orders", "o")],
        "joins": [{"type": "subquery", "right_alias": "u", "conditions": "c.c_custkey = u.o_custkey",
                   "subquery": "SELECT o_orderkey, o_custkey FROM {o} WHERE o_totalprice > 300000 "
                               "UNION SELECT o_orderkey, o_custkey FROM {o} WHERE o_orderpriority = '1-URGENT'"}],
        "transformations": _sel(("c_custkey", "c.c_custkey"), ("c_name", "c.c_name"),
                                ("o_orderkey", "u.o_orderkey")),
    })


def subquery_rollup(spark, sf_dir):
    """A ROLLUP subquery over customer, joined to the nation dimension. Customer is read only by the
    (partially aggregated) rollup; the join pairs each nation with its few rollup rows."""
    return _run(spark, sf_dir, {
        "tables": [_t("nation", "n"), _t("customer", "c")],
        "joins": [{"type": "subquery", "right_alias": "r", "conditions": "n.n_nationkey = r.nat",
                   "subquery": "SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n "
                               "FROM {c} GROUP BY ROLLUP (c_mktsegment, c_nationkey)"}],
        "transformations": _sel(("n_name", "n.n_name"), ("seg", "r.seg"), ("nat", "r.nat"), ("n", "r.n")),
    })


def subquery_topk(spark, sf_dir):
    """Join with an ORDER BY ... LIMIT 50 subquery."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c"), _t("orders", "o")],
        "joins": [{"type": "subquery", "right_alias": "t", "conditions": "c.c_custkey = t.o_custkey",
                   "subquery": "SELECT o_orderkey, o_custkey, o_totalprice FROM {o} "
                               "ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"}],
        "transformations": _sel(("c_name", "c.c_name"), ("o_orderkey", "t.o_orderkey"),
                                ("o_totalprice", "t.o_totalprice")),
    })


def subquery_setops(spark, sf_dir):
    """Join with an INTERSECT / EXCEPT subquery."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c"), _t("orders", "o")],
        "joins": [{"type": "subquery", "right_alias": "s", "conditions": "c.c_custkey = s.o_custkey",
                   "subquery": "(SELECT o_custkey FROM {o} WHERE o_orderstatus = 'F' "
                               "INTERSECT SELECT o_custkey FROM {o} WHERE o_orderstatus = 'O') "
                               "EXCEPT SELECT o_custkey FROM {o} WHERE o_orderstatus = 'P'"}],
        "transformations": _sel(("c_custkey", "c.c_custkey"), ("c_name", "c.c_name")),
    })


def _join_chain_spec() -> dict:
    return {
        "tables": [_t("customer", "c", "c_acctbal > 5000"), _t("orders", "o", "o_orderstatus = 'O'"),
                   _t("lineitem", "l", "l_returnflag = 'R'")],
        "joins": [{"type": "inner", "left_table": "c", "right_table": "o", "conditions": "c.c_custkey = o.o_custkey"},
                  {"type": "left", "left_table": "o", "right_table": "l", "conditions": "o.o_orderkey = l.l_orderkey"}],
        "predicates": "c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000",
    }


def join_chain(spark, sf_dir):
    """Inner then left join from the first table, a global predicate, D11 flattening."""
    return _run(spark, sf_dir, _join_chain_spec())


def join_chain_hot(spark, sf_dir):
    """``join_chain`` with the left join salted for keys that are hot on the lineitem side."""
    spec = _join_chain_spec()
    spec["joins"][1].update({"strategy": "salted", "conditions": "", "salt": {
        "left_keys": ["o.o_orderkey"], "right_keys": ["l.l_orderkey"], "salts": 4, "skewed_side": "right",
        "salt_from": ["l.l_linenumber", "l.l_partkey", "l.l_suppkey"], "hot_fraction": 0.0002}})
    return _run(spark, sf_dir, spec)


def _semi_anti(kind: str) -> dict:
    return {"tables": [_t("customer", "c"), _t("orders", "o", "o_totalprice > 300000")],
            "joins": [{"type": kind, "right_table": "o", "conditions": "c.c_custkey = o.o_custkey"}]}


def semi_join(spark, sf_dir):
    """Left semi join."""
    return _run(spark, sf_dir, _semi_anti("left_semi"))


def anti_join(spark, sf_dir):
    """Left anti join."""
    return _run(spark, sf_dir, _semi_anti("left_anti"))


def cross_join(spark, sf_dir):
    """Cross join, allowed because one side is measured small."""
    return _run(spark, sf_dir, {"tables": [_t("region", "r"), _t("nation", "n")],
                                "joins": [{"type": "cross", "right_table": "n", "conditions": ""}]})


def theta_join(spark, sf_dir):
    """A band condition. The ``band`` strategy turns it into an equi-join on value buckets, so it never
    falls back to a nested loop over all pairs."""
    return _run(spark, sf_dir, {
        "tables": [_t("part", "p", "p_size > 45"), _t("supplier", "s")],
        "joins": [{"type": "inner", "right_table": "s", "strategy": "band",
                   "conditions": "s.s_acctbal BETWEEN p.p_retailprice AND p.p_retailprice + 100",
                   "band": {"low": "p.p_retailprice", "high": "p.p_retailprice + 100",
                            "point": "s.s_acctbal", "width": 100}}],
        "transformations": _sel(("p_partkey", "p.p_partkey"), ("s_suppkey", "s.s_suppkey"),
                                ("p_retailprice", "p.p_retailprice"), ("s_acctbal", "s.s_acctbal")),
    })


def salted_join(spark, sf_dir):
    """Lineitem x part with every key salted 8 ways."""
    return _run(spark, sf_dir, {
        "tables": [_t("lineitem", "l"), _t("part", "p")],
        "joins": [{"type": "inner", "right_table": "p", "strategy": "salted",
                   "salt": {"left_keys": ["l.l_partkey"], "right_keys": ["p.p_partkey"], "salts": 8,
                            "salt_from": ["l.l_orderkey", "l.l_linenumber"]}}],
        "transformations": _sel(("l_orderkey", "l.l_orderkey"), ("l_linenumber", "l.l_linenumber"),
                                ("l_partkey", "l.l_partkey"), ("p_name", "p.p_name"),
                                ("p_retailprice", "p.p_retailprice")),
    })


def salted_left_join(spark, sf_dir):
    """Left join with only hot keys salted."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o", "o_totalprice > 100000"), _t("customer", "c", "c_acctbal > 8000")],
        "joins": [{"type": "left", "right_table": "c", "strategy": "salted",
                   "salt": {"left_keys": ["o.o_custkey"], "right_keys": ["c.c_custkey"], "salts": 8,
                            "salt_from": ["o.o_orderkey"], "hot_fraction": 0.001}}],
        "transformations": _sel(("o_orderkey", "o.o_orderkey"), ("o_custkey", "o.o_custkey"),
                                ("c_custkey", "c.c_custkey"), ("c_name", "c.c_name")),
    })


def salted_full_join(spark, sf_dir):
    """A full outer join with hot left keys salted: a salted left join plus the right rows without any
    partner (an anti join against the distinct left keys)."""
    base = sf_dir.rstrip("/")
    o = (spark.read.parquet(f"{base}/orders.parquet").filter("o_totalprice > 100000")
         .select("o_orderkey", "o_custkey", "o_totalprice"))
    c = spark.read.parquet(f"{base}/customer.parquet").filter("c_acctbal > 8000").select("c_custkey", "c_name")
    return salted_outer_join(o, c, ["o_custkey"], ["c_custkey"], "full", salts=8, salt_from=["o_orderkey"],
                             hot_fraction=0.001)


def salted_right_join(spark, sf_dir):
    """J3 + J13: a right outer join whose non-preserved (left) side has the hot keys, which AQE cannot
    split. The hot order keys are salted, their customer rows replicated, exactly."""
    base = sf_dir.rstrip("/")
    o = (spark.read.parquet(f"{base}/orders.parquet").filter("o_totalprice > 100000")
         .select("o_orderkey", "o_custkey", "o_totalprice"))
    c = spark.read.parquet(f"{base}/customer.parquet").filter("c_acctbal > 8000").select("c_custkey", "c_name")
    return salted_outer_join(o, c, ["o_custkey"], ["c_custkey"], "right", salts=8, salt_from=["o_orderkey"],
                             hot_fraction=0.001, skewed_side="left")


# ---------------------------------------------------------------------------------------------------------
# aggregation and windows
# ---------------------------------------------------------------------------------------------------------

def group_agg(spark, sf_dir):
    """Group key with sum, avg, count, max, min."""
    return _run(spark, sf_dir, {
        "tables": [_t("lineitem", "l")],
        "transformations": [
            {"output_column": "", "expression": "group by l_returnflag"},
            {"output_column": "sum_qty", "expression": "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2))"},
            # quantities are whole numbers, so the sum is exact in any order and avg is one IEEE division
            {"output_column": "avg_qty", "expression": "avg(l_quantity)"},
            {"output_column": "n_lines", "expression": "count(*)"},
            {"output_column": "max_disc", "expression": "max(l_discount)"},
            {"output_column": "min_ship", "expression": "min(l_shipdate)"},
        ],
    })


def group_multi(spark, sf_dir):
    """Two group keys across a join."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c"), _t("nation", "n")],
        "joins": [{"type": "inner", "right_table": "n", "conditions": "c.c_nationkey = n.n_nationkey"}],
        "transformations": [
            {"output_column": "", "expression": "group by n.n_name, c.c_mktsegment"},
            {"output_column": "n_customers", "expression": "count(*)"},
            {"output_column": "sum_bal", "expression": "CAST(sum(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(38,2))"},
        ],
    })


def count_distinct(spark, sf_dir):
    """count(distinct ...)."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c")],
        "transformations": [
            {"output_column": "", "expression": "group by c_mktsegment"},
            {"output_column": "n_nations", "expression": "count(distinct c_nationkey)"},
            {"output_column": "n_customers", "expression": "count(c_custkey)"},
        ],
    })


def conditional_agg(spark, sf_dir):
    """Expressions inside and around aggregates."""
    return _run(spark, sf_dir, {
        "tables": [_t("customer", "c")],
        "transformations": [
            {"output_column": "", "expression": "group by c_mktsegment"},
            {"output_column": "n_rich", "expression": "sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END)"},
            {"output_column": "rich_share",
             "expression": "CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"},
            {"output_column": "neg_bal",
             "expression": "CAST(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END) "
                           "AS DECIMAL(38,2))"},
        ],
    })


def global_agg(spark, sf_dir):
    """Aggregates without a key."""
    return _run(spark, sf_dir, {
        "tables": [_t("lineitem", "l")],
        "transformations": [
            {"output_column": "sum_price",
             "expression": "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2))"},
            {"output_column": "n_lines", "expression": "count(*)"},
        ],
    })


def window_rank(spark, sf_dir):
    """Ranking window as an added column; a customer above 1% of the orders would be split."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": [{"output_column": "price_rank", "expression":
                             "CAST(row_number() OVER (PARTITION BY o_custkey "
                             "ORDER BY o_totalprice DESC, o_orderkey) AS INT)",
                             "skew_safe": {"partition_by": ["o_custkey"],
                                           "order_by": [["o_totalprice", "desc"], ["o_orderkey", "asc"]],
                                           "func": "row_number", "cast": "int"}}],
    })


def window_sum(spark, sf_dir):
    """Aggregate window standing alone (added column); hot customers would be split."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": [{"output_column": "running_total", "expression":
                             "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey "
                             "ORDER BY o_orderdate, o_orderkey) AS DECIMAL(38,2))",
                             "skew_safe": {"partition_by": ["o_custkey"],
                                           "order_by": [["o_orderdate", "asc"], ["o_orderkey", "asc"]],
                                           "func": "running_sum", "value": "CAST(o_totalprice AS DECIMAL(18,2))",
                                           "cast": "decimal(38,2)"}}],
    })


def window_frame(spark, sf_dir):
    """Lag and a ROWS frame; hot users would be split."""
    safe = {"partition_by": ["user_id"], "order_by": [["ts", "asc"], ["event_id", "asc"]]}
    return _run(spark, sf_dir, {
        "tables": [_t("events", "e")],
        "transformations": [
            {"output_column": "prev_value",
             "expression": "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
             "skew_safe": {**safe, "func": "lag", "value": "value"}},
            {"output_column": "n_last3", "expression":
             "CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id "
             "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)",
             "skew_safe": {**safe, "func": "rows_count", "preceding": 2, "cast": "bigint"}},
        ],
    })


# The same three windows with the hot share set low enough that many keys take the split path at this
# scale (operators.windows), so the bucketed plan itself is exercised and checked.

def window_rank_hot(spark, sf_dir):
    """W1 with hot partition keys split into ordered buckets."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": [{"output_column": "price_rank", "expression":
                             "CAST(row_number() OVER (PARTITION BY o_custkey "
                             "ORDER BY o_totalprice DESC, o_orderkey) AS INT)",
                             "skew_safe": {"partition_by": ["o_custkey"],
                                           "order_by": [["o_totalprice", "desc"], ["o_orderkey", "asc"]],
                                           "func": "row_number", "cast": "int", "hot_fraction": 0.001}}],
    })


def window_sum_hot(spark, sf_dir):
    """W2 with hot partition keys split into ordered buckets."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": [{"output_column": "running_total", "expression":
                             "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey "
                             "ORDER BY o_orderdate, o_orderkey) AS DECIMAL(38,2))",
                             "skew_safe": {"partition_by": ["o_custkey"],
                                           "order_by": [["o_orderdate", "asc"], ["o_orderkey", "asc"]],
                                           "func": "running_sum", "value": "CAST(o_totalprice AS DECIMAL(18,2))",
                                           "cast": "decimal(38,2)", "hot_fraction": 0.001}}],
    })


def window_frame_hot(spark, sf_dir):
    """W3 with hot partition keys split into ordered buckets."""
    safe = {"partition_by": ["user_id"], "order_by": [["ts", "asc"], ["event_id", "asc"]], "hot_fraction": 0.005}
    return _run(spark, sf_dir, {
        "tables": [_t("events", "e")],
        "transformations": [
            {"output_column": "prev_value",
             "expression": "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
             "skew_safe": {**safe, "func": "lag", "value": "value"}},
            {"output_column": "n_last3", "expression":
             "CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id "
             "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)",
             "skew_safe": {**safe, "func": "rows_count", "preceding": 2, "cast": "bigint"}},
        ],
    })


def window_analytics(spark, sf_dir):
    """Rank, dense_rank, lead and a framed sum per customer, hot customers split into buckets."""
    by_date = {"partition_by": ["o_custkey"], "hot_fraction": 0.001}
    unique = [["o_orderdate", "asc"], ["o_orderkey", "asc"]]
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o")],
        "transformations": [
            {"output_column": "date_rank",
             "expression": "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT)",
             "skew_safe": {**by_date, "order_by": [["o_orderdate", "asc"]], "func": "rank", "cast": "int"}},
            {"output_column": "date_dense_rank",
             "expression": "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT)",
             "skew_safe": {**by_date, "order_by": [["o_orderdate", "asc"]], "func": "dense_rank", "cast": "int"}},
            {"output_column": "next_order",
             "expression": "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
             "skew_safe": {**by_date, "order_by": unique, "func": "lead", "value": "o_orderkey"}},
            {"output_column": "last3_total", "expression":
             "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, "
             "o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2))",
             "skew_safe": {**by_date, "order_by": unique, "func": "rows_sum", "preceding": 2,
                           "value": "CAST(o_totalprice AS DECIMAL(18,2))", "cast": "decimal(38,2)"}},
        ],
    })


def theta_grid(spark, sf_dir):
    """Inequalities on two columns. Urgent orders beaten by far dearer low-priority orders of long before."""
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "u", "o_orderpriority = '1-URGENT'"), _t("orders", "p", "o_orderpriority = '5-LOW'")],
        "joins": [{"type": "inner", "right_table": "p", "strategy": "grid",
                   "theta": {"bounds": [["u.o_totalprice + 450000", "<", "p.o_totalprice"],
                                        ["datediff(u.o_orderdate, DATE '1970-01-01')", ">=", "datediff(p.o_orderdate, DATE '1970-01-01') + 2200"]]}}],
        "transformations": _sel(("urgent_key", "u.o_orderkey"), ("low_key", "p.o_orderkey"), ("urgent_price", "u.o_totalprice"), ("low_price", "p.o_totalprice")),
    })


def overlap_join(spark, sf_dir):
    """Overlap of two spans. The first week of dear finished orders with the days that large returned items travel
    (longer for larger ones, so spans of several levels)."""
    day = "unix_date(CAST({} AS DATE))"
    return _run(spark, sf_dir, {
        "tables": [_t("orders", "o", "o_orderstatus = 'F' AND o_totalprice > 300000"),
                   _t("lineitem", "l", "l_returnflag = 'R' AND l_quantity >= 48 AND l_discount >= 0.08")],
        "joins": [{"type": "inner", "right_table": "l", "strategy": "overlap",
                   "theta": {"left": [day.format("o.o_orderdate"), day.format("o.o_orderdate") + " + 7"],
                             "right": [day.format("l.l_shipdate"), day.format("l.l_shipdate") + " + CASE WHEN l.l_linenumber = 7 THEN 90 ELSE l.l_linenumber END"]}}],
        "transformations": _sel(("o_orderkey", "o.o_orderkey"), ("l_orderkey", "l.l_orderkey"), ("l_linenumber", "l.l_linenumber"),
                                ("o_orderdate", "o.o_orderdate"), ("l_shipdate", "l.l_shipdate")),
    })


# ---------------------------------------------------------------------------------------------------------
# whole jobs
# ---------------------------------------------------------------------------------------------------------

def spec_agg(spark, sf_dir):
    """The join chain with group keys and aggregates."""
    spec = _join_chain_spec()
    spec["transformations"] = [
        {"output_column": "", "expression": "group by c.c_nationkey, o.o_orderpriority"},
        {"output_column": "n_rows", "expression": "count(*)"},
        {"output_column": "n_returned", "expression": "count(l.l_orderkey)"},
        {"output_column": "sum_qty", "expression": "CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2))"},
        {"output_column": "max_price", "expression": "max(o.o_totalprice)"},
    ]
    return _run(spark, sf_dir, spec)


def spec_select(spark, sf_dir):
    """The join chain with a select list."""
    spec = _join_chain_spec()
    spec["transformations"] = _sel(
        ("c_name", "c.c_name"), ("o_orderkey", "o.o_orderkey"), ("l_linenumber", "l.l_linenumber"),
        ("revenue", "l.l_extendedprice * (1 - l.l_discount)"),
        ("is_urgent", "o.o_orderpriority = '1-URGENT'"))
    return _run(spark, sf_dir, spec)
