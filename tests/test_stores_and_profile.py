"""Batches that are appended once, bucketed tables without a shuffle, and the profile of every column."""

import collections
import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkwright import run_job
from sparkwright.operators.profile import candidates, column_profile
from sparkwright.plans import stores
from sparkwright.sources import batches
from sparkwright.sources.sinks import Target, bucket_count, bucketed

from conftest import SF_SMALL


def explained(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def ids(spark, path):
    return sorted(r.id for r in batches.read_batches(spark, path, "id bigint").collect())


def test_a_batch_is_in_the_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ids(spark, path) == [] and not batches.is_committed(spark, path, "a")
    assert batches.append_batch(spark.range(5), path, "a")
    assert not batches.append_batch(spark.range(100, 200), path, "a")  # the second run's rows do not matter
    assert batches.append_batch(spark.range(10, 12), path, 7)
    assert ids(spark, path) == [0, 1, 2, 3, 4, 10, 11]
    assert set(batches.committed_batches(spark, path)) == {"a", "7"}


def test_a_write_that_breaks_off_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "t")
    broken = spark.range(0, 1000, 1, 4).withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        batches.append_batch(broken, path, "a")
    assert not batches.is_committed(spark, path, "a")
    batches.append_batch(spark.range(3), path, "a")
    assert ids(spark, path) == [0, 1, 2]


def test_of_two_runs_at_once_one_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    first, second = batches.stage_batch(spark.range(3), path, "a"), batches.stage_batch(spark.range(5, 9), path, "a")
    assert ids(spark, path) == []
    assert batches.commit_batch(spark, path, "a", second)
    assert not batches.commit_batch(spark, path, "a", first)
    assert ids(spark, path) == [5, 6, 7, 8] and batches.committed_batches(spark, path) == {"a": second}


@pytest.mark.parametrize("name", ["", "../x", "a/b", ".hidden", "_x"])
def test_batch_ids_are_plain_names(spark, tmp_path, name):
    with pytest.raises(ValueError, match="batch id"):
        batches.append_batch(spark.range(1), str(tmp_path), name)
    with pytest.raises(ValueError, match="no committed batch"):
        batches.read_batches(spark, str(tmp_path / "none"))


def test_a_streams_batches_replayed_after_a_restart(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    spark.range(20).write.parquet(source)

    def run(checkpoint):
        rows = spark.readStream.schema("id bigint").parquet(source)
        q = rows.writeStream.foreachBatch(batches.foreach_batch(table)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run("one")
    run("two")  # the first checkpoint is lost: the same micro-batch comes again
    assert ids(spark, table) == list(range(20))
    spark.range(20, 30).write.mode("append").parquet(source)
    run("one")
    assert ids(spark, table) == list(range(30))


@pytest.fixture()
def shuffled(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_bucketed_tables_join_and_aggregate_without_exchange(shuffled):
    df = E.queries()["bucketed_join"](shuffled, SF_SMALL)
    p = explained(df)
    assert "SortMergeJoin" in p and "Exchange" not in p and len(re.findall(r"Bucketed: true", p)) == 2
    # one file a bucket at most, whatever the number of tasks
    files = df.inputFiles()
    assert len(files) <= 16


def test_joined_buckets_grow_with_the_rows(shuffled):
    # some 6,000 lines of 32 bytes: a task sorts a bucket's rows, so a bucket has so many at most
    df = stores.bucketed_join(shuffled, SF_SMALL, bucket_bytes=13_000)
    assert len(re.findall(r"SelectedBucketsCount: 16 out of 16", explained(df))) == 2 and "Exchange" not in explained(df)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, E.queries()["bucketed_join"](shuffled, SF_SMALL).collect()))


def test_bucket_numbers_and_errors(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert bucket_count(df) == 1 and bucket_count(df, 4096) == 8
    rows, n = bucketed(df, Target("t", bucket_by=["k"], buckets=5))
    assert n == 5 and rows.rdd.getNumPartitions() == 5
    with pytest.raises(ValueError, match="must be columns"):
        bucketed(df, Target("t", bucket_by=["nope"]))
    spec = {"tables": [{"name": "t", "alias": "t"}], "target": {"table": "x", "bucket_by": ["k"], "columns": ["id", "k"]}}
    with pytest.raises(ValueError, match="bucketed write"):
        run_job(spark, spec, resolver=lambda *a, **k: df)


def brute(rows, names, share):
    out = set()
    for i, name in enumerate(names):
        for v, n in collections.Counter(r[i] for r in rows).items():
            if n >= share * len(rows):
                out.add((name, v, n, len(rows)))
    return out


@pytest.mark.parametrize("share", [0.02, 0.1, 0.5, 1.0])
def test_profile_finds_every_heavy_value_exactly(spark, share):
    rng = random.Random(12)
    rows = []
    for i in range(20_000):
        rows.append((str(i), rng.choice(["a", "b", None, f"x{rng.randrange(5000)}"]), "same", str(min(99, int(rng.expovariate(0.2))))))
    names = ["unique", "mixed", "same", "skewed"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).repartition(13)
    got = {tuple(r) for r in column_profile(df, share=share).collect()}
    assert got == brute(rows, names, share)


def test_profile_of_other_types_and_of_nothing(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    got = {(r.column_name, r.value): r.n for r in column_profile(df, ["l_returnflag", "l_tax", "l_shipdate", "l_linenumber"], 0.05).collect()}
    for c in ("l_returnflag", "l_linenumber"):
        for r in df.groupBy(c).count().where(F.col("count") >= 0.05 * df.count()).collect():
            assert got.pop((c, str(r[0]))) == r["count"]
    assert all(c == "l_tax" for c, _ in got) and got
    assert column_profile(df.where("false"), ["l_tax"]).collect() == []
    with pytest.raises(ValueError, match="share"):
        candidates(df, ["l_tax"], 0.0001)
    with pytest.raises(ValueError, match="no profile"):
        column_profile(df.withColumn("a", F.array(F.lit(1))), ["a"])


def test_profile_scans_without_a_shuffle_of_rows(shuffled):
    df = shuffled.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = explained(column_profile(df, ["l_returnflag", "l_tax"]))
    assert p.count("FileScan") == 1 and "Expand" not in p and "Python" not in p
    assert all("SinglePartition" in line for line in p.splitlines() if "Exchange" in line)
