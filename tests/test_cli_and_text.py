"""The command line runner and recommendations from comma-text descriptors."""

import json
import subprocess
import sys


from sparkwright.functions import jobs as J
from sparkwright.operators.partitioning import spread_if_narrow

from conftest import SF_SMALL

DESCRIPTOR_COLS = ("job_id long, num_tables int, table_sizes string, join_complexities string, "
                   "transformation_complexities string, data_skews string, use_spot_instances boolean, "
                   "sla_requirements boolean, enable_auto_termination boolean, recency int, frequency int, "
                   "workload_type string")


def test_recommend_from_text_matches_worked_case(spark):
    d = spark.createDataFrame([(1, 6, "1,301", "7", "7", "7", True, False, False, 7, 4, None),
                               (2, 1, "", "5", "5", "5", False, False, False, 5, 5, None),
                               (3, 2, "2000", "1", "9", "1", True, True, False, 0, 0, "General")], DESCRIPTOR_COLS)
    r = {x.job_id: x for x in J.recommend_from_text(d).collect()}
    assert r[1].computed_type == "Data Caching/Analysis" and r[1].cores == 15 and r[1].workers == 4
    assert r[2].status == "empty list" and r[2].computed_type is None
    assert r[3].computed_type == "ML/High Memory" and r[3].sizing_type == "General" and r[3].spot_workers == 1


def test_spread_if_narrow(spark):
    one = spark.range(0, 100, numPartitions=1)
    assert spread_if_narrow(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism + 1)
    assert spread_if_narrow(wide) is wide


def test_cli_runs_saved_job(tmp_path):
    spec = {"tables": [{"name": "orders", "alias": "o", "path": f"{SF_SMALL}/orders.parquet",
                        "predicate": "o_totalprice > 400000"}],
            "transformations": [{"output_column": "", "expression": "group by o_orderstatus"},
                                {"output_column": "n", "expression": "count(*)"}]}
    p = tmp_path / "job.json"
    p.write_text(json.dumps(spec))
    out = subprocess.run([sys.executable, "-m", "sparkwright", str(p), "--preview", "5"],
                         capture_output=True, text=True, timeout=300,
                         cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert out.returncode == 0, out.stderr[-2000:]
    assert "o_orderstatus" in out.stdout
    plan = subprocess.run([sys.executable, "-m", "sparkwright", str(p), "--explain"],
                          capture_output=True, text=True, timeout=300,
                          cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert plan.returncode == 0 and "PushedFilters" in plan.stdout


def test_shared_dir_reads_session_and_falls_back_only_locally():
    from types import SimpleNamespace

    import pytest as _pytest

    from sparkwright.session import shared_dir

    class Ctx:
        def __init__(self, master, conf):
            self.master, self._conf, self.applicationId, self.dirs = master, conf, f"app-{master}", []

        def getConf(self):
            return SimpleNamespace(get=lambda k, d=None: self._conf.get(k, d))

        def setCheckpointDir(self, d):
            self.dirs.append(d)

    set_ctx = Ctx("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared"})
    assert shared_dir(SimpleNamespace(sparkContext=set_ctx)) == "hdfs://nn/shared" and set_ctx.dirs == []
    with _pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=Ctx("yarn", {})))
    local = Ctx("local[2]", {})
    a = shared_dir(SimpleNamespace(sparkContext=local))
    assert a == shared_dir(SimpleNamespace(sparkContext=local)) and local.dirs == [a]


def test_example_fact_job_runs_as_written(spark):
    """The example spec, unchanged, against catalog tables built from the small tables (FIXTURES mapping)."""
    import pathlib

    from sparkwright.plans.facts import fact_sales
    from sparkwright.plans.run import run_job

    for db in ("Prepared", "Sales_DW"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    src = {t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("lineitem", "orders", "part", "customer",
                                                                      "supplier")}
    views = {
        "Prepared.Sales": src["lineitem"].selectExpr(
            "l_orderkey AS Order_Id", "l_partkey AS Product_Id", "l_suppkey AS SalesRep_Id",
            "l_quantity AS Quantity", "l_discount AS Discount", "l_tax AS Tax_Rate"),
        "Sales_DW.DimOrders": src["orders"].selectExpr(
            "o_orderkey AS Order_Id", "o_custkey AS Customer_Id", "CAST(o_orderdate AS DATE) AS Order_Date",
            "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS Tax_Applicable"),
        "Sales_DW.DimProduct": src["part"].selectExpr(
            "p_partkey AS Product_Id", "p_retailprice AS Product_List_Price", "0.0D AS Product_Discount",
            "0.6 * p_retailprice AS Product_Cost"),
        "Sales_DW.DimCustomer": src["customer"].selectExpr("c_custkey AS Customer_Id"),
        "Sales_DW.DimSalesRep": src["supplier"].selectExpr("s_suppkey AS SalesRep_Id"),
        "Sales_DW.DimDate": src["orders"].selectExpr(
            "CAST(o_orderdate AS DATE) AS Full_Date",
            "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS Date_Key").distinct(),
    }
    for name, df in views.items():
        df.write.mode("overwrite").saveAsTable(name)
    spark.sql("CREATE TABLE IF NOT EXISTS Sales_DW.Fact_Sales (FK_Order_Id BIGINT, FK_Product_Id BIGINT, "
              "FK_Customer_Id BIGINT, FK_SalesRep_Id BIGINT, FK_Date_Key INT, Quantity_Sold DOUBLE, "
              "Sales_Amount DOUBLE, Discount_Amount DOUBLE, Net_Sales_Amount DOUBLE, Profit_Amount DOUBLE, "
              "Tax_Amount DOUBLE, Total_Amount DOUBLE) USING parquet")
    spec = json.loads((pathlib.Path(__file__).resolve().parents[1] / "examples" / "fact_sales_job.json").read_text())
    out = run_job(spark, spec)
    assert out.count() == fact_sales(spark, SF_SMALL).count() > 0
    # every loaded key pair matches the registered fact query
    got = {(r.FK_Order_Id, r.FK_Product_Id, r.FK_Date_Key) for r in out.collect()}
    want = {(r.FK_Order_Id, r.FK_Product_Id, r.FK_Date_Key) for r in fact_sales(spark, SF_SMALL).collect()}
    assert got == want
