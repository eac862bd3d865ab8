"""The star-join fact table load (S10, J10, J11, F4-F6) on the driver's tables.

Mapping: Sales = lineitem, DimOrders = orders (tax applies when ``o_orderstatus = 'F'``), DimProduct = part
(list price ``p_retailprice``, cost ``0.6 * p_retailprice``, discount from the sale's ``l_discount``),
DimCustomer = customer, DimSalesRep = supplier, DimDate = the distinct order dates keyed ``yyyymmdd``,
tax rate = ``l_tax``.

Plan at scale: the chain starts from orders, so the customer join shuffles orders rather than the fact,
and the date dimension (a partial+final distinct over one column of orders: a few thousand rows at any
scale) is broadcast onto orders. The fact then meets orders on the order key and part on the part key,
two shuffles of the fact in total. The sales-rep and date dimensions use the ``broadcast`` strategy,
which broadcasts only after a measured bound. AQE may still broadcast part or customer when they are
small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_location, fresh_table_name
from ..sources.sinks import create_table
from ..sources.tables import parquet_dir_resolver
from .run import run_job

FACT_COLUMNS = ["FK_Order_Id", "FK_Product_Id", "FK_Customer_Id", "FK_SalesRep_Id", "FK_Date_Key",
                "Quantity_Sold", "Sales_Amount", "Discount_Amount", "Net_Sales_Amount", "Profit_Amount",
                "Tax_Amount", "Total_Amount"]

FACT_DDL = ("FK_Order_Id BIGINT, FK_Product_Id BIGINT, FK_Customer_Id BIGINT, FK_SalesRep_Id BIGINT, "
            "FK_Date_Key INT, Quantity_Sold DOUBLE, Sales_Amount DOUBLE, Discount_Amount DOUBLE, "
            "Net_Sales_Amount DOUBLE, Profit_Amount DOUBLE, Tax_Amount DOUBLE, Total_Amount DOUBLE, "
            "Load_Note STRING")


def fact_sales_spec() -> dict:
    """The fact load as a job spec (P2): five joins, twelve outputs, lateral aliases, CASE."""
    # Dimension-first chain: orders joins customer (a shuffle of orders, not of the fact) and the
    # broadcast date dimension before the fact arrives. The fact is then shuffled twice (order key, part
    # key) instead of three times. All joins are inner, so the order does not change the result.
    return {
        "tables": [
            {"name": "orders", "alias": "o"},
            {"name": "customer", "alias": "c"},
            {"name": "lineitem", "alias": "s"},
            {"name": "part", "alias": "p"},
            {"name": "supplier", "alias": "r"},
        ],
        "joins": [
            {"type": "inner", "right_table": "c", "conditions": "o.o_custkey = c.c_custkey"},
            {"type": "subquery", "right_alias": "d", "strategy": "broadcast",
             "conditions": "CAST(o.o_orderdate AS DATE) = d.full_date",
             "subquery": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date, "
                         "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS date_key FROM {o}"},
            {"type": "inner", "right_table": "s", "conditions": "s.l_orderkey = o.o_orderkey"},
            {"type": "inner", "right_table": "p", "conditions": "s.l_partkey = p.p_partkey"},
            {"type": "inner", "right_table": "r", "conditions": "s.l_suppkey = r.s_suppkey",
             "strategy": "broadcast"},
        ],
        "transformations": [
            {"output_column": "FK_Order_Id", "expression": "o.o_orderkey"},
            {"output_column": "FK_Product_Id", "expression": "p.p_partkey"},
            {"output_column": "FK_Customer_Id", "expression": "c.c_custkey"},
            {"output_column": "FK_SalesRep_Id", "expression": "r.s_suppkey"},
            {"output_column": "FK_Date_Key", "expression": "d.date_key"},
            {"output_column": "Quantity_Sold", "expression": "s.l_quantity"},
            {"output_column": "Sales_Amount", "expression": "s.l_quantity * p.p_retailprice"},
            {"output_column": "Discount_Amount", "expression": "s.l_discount * p.p_retailprice"},
            {"output_column": "Net_Sales_Amount",
             "expression": "(s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice)"},
            {"output_column": "Profit_Amount",
             "expression": "((s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice))"
                           " - (s.l_quantity * (0.6 * p.p_retailprice))"},
            # lateral aliases: the next two name columns defined just above
            {"output_column": "Tax_Amount",
             "expression": "CASE WHEN o.o_orderstatus = 'F' THEN (Net_Sales_Amount * s.l_tax) ELSE 0 END"},
            {"output_column": "Total_Amount", "expression": "(Net_Sales_Amount + Tax_Amount)"},
        ],
    }


def fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact rows, not written."""
    return run_job(spark, fact_sales_spec(), resolver=parquet_dir_resolver(sf_dir))


def fact_sales_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create the target with one extra column, then ``INSERT INTO t (12 columns) SELECT ...``.

    The unlisted ``Load_Note`` column receives null. The returned frame reads the loaded table back.
    """
    name = fresh_table_name("fact_sales")
    create_table(spark, name, FACT_DDL, path=fresh_location(spark, "fact_sales"))
    spec = fact_sales_spec()
    # the select list is positional here: plain column references, mapped onto the listed target columns
    spec["target"] = {"table": name, "mode": "append", "columns": FACT_COLUMNS}
    return run_job(spark, spec, resolver=parquet_dir_resolver(sf_dir))


_FACT_SQL = """
SELECT o.o_orderkey AS FK_Order_Id, p.p_partkey AS FK_Product_Id, c.c_custkey AS FK_Customer_Id,
       r.s_suppkey AS FK_SalesRep_Id, d.date_key AS FK_Date_Key, s.l_quantity AS Quantity_Sold,
       s.l_quantity * p.p_retailprice AS Sales_Amount,
       s.l_discount * p.p_retailprice AS Discount_Amount,
       (s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice) AS Net_Sales_Amount,
       ((s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice))
         - (s.l_quantity * (0.6 * p.p_retailprice)) AS Profit_Amount,
       CASE WHEN o.o_orderstatus = 'F'
            THEN ((s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice)) * s.l_tax
            ELSE 0 END AS Tax_Amount,
       ((s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice))
         + CASE WHEN o.o_orderstatus = 'F'
                THEN ((s.l_quantity * p.p_retailprice) - (s.l_discount * p.p_retailprice)) * s.l_tax
                ELSE 0 END AS Total_Amount{extra}
FROM lineitem s
JOIN orders o ON s.l_orderkey = o.o_orderkey
JOIN part p ON s.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier r ON s.l_suppkey = r.s_suppkey
JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date,
             CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders) d
  ON CAST(o.o_orderdate AS DATE) = d.full_date
"""

SQL = {
    "fact_sales": _FACT_SQL.format(extra=""),
    "fact_sales_load": _FACT_SQL.format(extra=",\n       CAST(NULL AS VARCHAR) AS Load_Note"),
}
