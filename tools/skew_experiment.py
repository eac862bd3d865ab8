"""Reproduce the skew measurements in PLANS.md.

    python tools/skew_experiment.py [sf_dir]

About a third of lineitem's rows are moved onto one order key. Then the plain and the skew-safe window,
and the plain and the right-salted ``orders LEFT JOIN lineitem``, each run to completion (noop sink). Wall
times are printed, and per-task times are read from Spark's event log, written to a fresh scratch folder.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-exp-")
    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F

    from sparkwright.operators.joins import Chain
    from sparkwright.operators.windows import WinOut, skew_safe_window

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.sql.shuffle.partitions", "16").config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot = li.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def run(label, df):
        spark.sparkContext.setJobGroup(label, label)
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        print(f"{label}: wall {time.time() - t0:.2f}s")

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_shipdate")
    run("window_plain", hot.select("*", F.row_number().over(w).alias("rn")))
    run("window_skew_safe", skew_safe_window(hot, ["l_orderkey"], [("l_partkey", True), ("l_suppkey", True),
                                                                     ("l_shipdate", True)],
                                             [WinOut("row_number", "rn")], hot_fraction=0.01, buckets=16))
    run("leftjoin_plain", orders.join(hot, orders.o_orderkey == hot.l_orderkey, "left"))
    chain = Chain.of(orders.alias("o"), "o").join_salted(
        hot, "l", None, "left", ["o.o_orderkey"], ["l.l_orderkey"], salts=16,
        salt_from=["l.l_linenumber", "l.l_partkey", "l.l_suppkey"], hot_fraction=0.01, skewed_side="right")
    run("leftjoin_salted", chain.df)
    spark.stop()

    import zstandard

    stage_group, tasks = {}, collections.defaultdict(list)
    for fn in sorted(glob.glob(f"{log_dir}/*/events_*")) + sorted(glob.glob(f"{log_dir}/*.zstd")):
        raw = open(fn, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if fn.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerJobStart":
                for sid in e["Stage IDs"]:
                    stage_group[sid] = (e.get("Properties") or {}).get("spark.jobGroup.id")
            elif e.get("Event") == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks[e["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
    slowest = collections.defaultdict(int)
    for sid, ds in tasks.items():
        g = stage_group.get(sid)
        if g:
            slowest[g] = max(slowest[g], max(ds))
    for g, ms in slowest.items():
        print(f"{g}: slowest task {ms} ms")


if __name__ == "__main__":
    main(sys.argv)
