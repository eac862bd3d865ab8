"""Key-skew profile (K14): measure what the reference asks the user to type in by hand.

For each profiled key: rows, distinct keys, the largest key's row count, the mean rows per key, and a skew
score from 1 (even) to 10 (very skewed): ``least(10, greatest(1, round(max / mean)))``.

Each key is two aggregates: a count per key value (partial counts map-side, so a key holding a third of the
rows costs one counter per task, not a hot shuffle partition), then an aggregate over the counts. Several
keys share one scan through grouping sets.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_frequencies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def profile_one(df: DataFrame, key: str, table_name: str) -> DataFrame:
    freq = key_frequencies(df, key)
    stats = freq.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("max_freq"))
    avg = F.col("n_rows").cast("double") / F.col("n_keys")
    return stats.select(F.lit(table_name).alias("table_name"), F.lit(key).alias("key_column"),
                        F.col("n_rows").cast("bigint").alias("n_rows"), "n_keys", "max_freq",
                        avg.alias("avg_freq"),
                        F.least(F.lit(10), F.greatest(F.lit(1), F.round(F.col("max_freq") / avg)))
                        .cast("int").alias("skew"))


def key_skew_profile(df: DataFrame, keys: list[str], table_name: str = "") -> DataFrame:
    """One row per profiled key column, from a single scan.

    Several keys are counted together with grouping sets: one expand and one partial aggregate per task,
    so profiling k columns of a large table reads it once, not k times. ``grouping_id`` tells the sets
    apart: for key i of n it has every bit set except bit n-1-i.
    """
    if len(keys) == 1:
        return profile_one(df, keys[0], table_name)
    n = len(keys)
    counts = (df.groupingSets([[k] for k in keys], *keys)
                .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))
    stats = counts.groupBy("gid").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                                      F.max("n").alias("max_freq"))
    full = (1 << n) - 1
    key_name = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        key_name = F.when(F.col("gid") == F.lit(full - (1 << (n - 1 - i))), F.lit(k)).otherwise(key_name)
    avg = F.col("n_rows").cast("double") / F.col("n_keys")
    return stats.select(F.lit(table_name).alias("table_name"), key_name.alias("key_column"),
                        F.col("n_rows").cast("bigint").alias("n_rows"), "n_keys", "max_freq",
                        avg.alias("avg_freq"),
                        F.least(F.lit(10), F.greatest(F.lit(1), F.round(F.col("max_freq") / avg)))
                        .cast("int").alias("skew"))


def hot_key_count(df: DataFrame, keys: list[str], hot_fraction: float) -> int:
    """How many key values hold more than ``hot_fraction`` of the rows (at most ``1/hot_fraction``)."""
    total = df.count()
    threshold = max(1, int(total * hot_fraction))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > threshold).count()


def join_advice(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                how: str = "inner", hot_fraction: float = 0.01, salts: int = 16,
                max_broadcast_rows: int = 2_000_000, max_broadcast_bytes: int = 256 << 20) -> dict:
    """The join-step settings a spec should carry for this join, measured rather than guessed.

    In order: a right side proven small is broadcast (for join types that can build on the right). Then
    hot keys are looked for on the side AQE cannot split for this join type: the right side of left, semi
    and anti joins, the left side of right joins, and both sides of full joins. Inner joins are left to AQE's
    skew-join splitting. Returns ``{}`` when the plain join is fine.
    """
    from .joins import fits_broadcast, spark_join_type

    how = spark_join_type(how)
    if how in ("inner", "left", "left_semi", "left_anti") and \
            fits_broadcast(right, max_broadcast_rows, max_broadcast_bytes):
        return {"strategy": "broadcast"}
    salt = {"left_keys": left_keys, "right_keys": right_keys, "salts": salts, "hot_fraction": hot_fraction}
    if how in ("left", "left_semi", "left_anti") and hot_key_count(right, right_keys, hot_fraction):
        return {"strategy": "salted", "conditions": "", "salt": {**salt, "skewed_side": "right"}}
    if how in ("right", "full") and hot_key_count(left, left_keys, hot_fraction):
        return {"strategy": "salted", "conditions": "", "salt": {**salt, "skewed_side": "left"}}
    if how == "full" and hot_key_count(right, right_keys, hot_fraction):
        return {"strategy": "salted", "conditions": "", "salt": {**salt, "skewed_side": "right"}}
    return {}
