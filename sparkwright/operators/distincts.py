"""Exact distinct counts that merge (A8): bitmaps over dense codes, stored once and combined for every coarser level.

``count(distinct x)`` by day can't be added up to months: the same value counts on many days. A bitmap of the values'
codes can, by OR. A value's code is a number from 0 without gaps; bitmaps hold 32,768 codes each, so a level's table has
one row of at most 4 KB for each group and range of codes in use. That pays off where a group holds a fair part of a
range's codes; for groups of a few values among very many, a plain distinct count moves less.

Columns of whole numbers that are dense already (surrogate keys) are their own codes. Other columns get codes from
``dense_codes``, a table of the distinct values numbered over sorted ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_location


def _written(df: DataFrame, label: str) -> DataFrame:
    where = fresh_location(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: the distinct non-null values of a column and their places from 0 in sorted order.

    The values are dealt by ranges and numbered within each; a range's first number is the count of those before it.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    dealt = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("__at", F.monotonically_increasing_id())
    dealt = _written(dealt, "codes").withColumn("__part", F.shiftright("__at", 33))
    # one row a range
    parts = dealt.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", (before - F.col("__first")).alias("__shift"))
    return dealt.join(F.broadcast(parts), "__part").select("value", (F.col("__at") + F.col("__shift")).alias("code"))


def bitmaps(df: DataFrame, keys: list[str], codes: dict[str, str]) -> DataFrame:
    """One row for each group, counted column and range of codes: keys, ``counted``, ``bucket``, ``bitmap``.

    ``codes``: name of the count -> SQL expression of the code. All columns share one pass: a row becomes one (name,
    code) pair for each, combined into bitmaps before the shuffle. A null code is not counted, but keeps its group, as
    an empty bitmap.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("counted"), F.expr(code).cast("bigint").alias("code")) for name, code in codes.items()])
    rows = df.select(*keys, F.inline(pairs))
    return (rows.groupBy(*keys, "counted", F.bitmap_bucket_number("code").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bitmap")))


def merge(level: DataFrame, keys: list) -> DataFrame:
    """The bitmaps of a coarser level; ``keys`` are columns or expressions over the finer one's."""
    return level.groupBy(*keys, "counted", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counts(level: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and one distinct count for each name (0 where a group has no value)."""
    return level.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("counted") == n, F.bitmap_count("bitmap"))), F.lit(0)).cast("bigint").alias(n)
                                      for n in names])


def distinct_levels(df: DataFrame, finest: dict[str, str], levels: list[tuple[str, dict[str, str]]], codes: dict[str, str]) -> DataFrame:
    """Distinct counts at several levels, each merged from the one before it.

    ``finest``: key -> SQL expression over the input. ``levels``: (name, key -> SQL expression over the keys of the
    level before), the first of which is the finest itself. The finest bitmaps are written under the shared folder.
    Columns: ``level``, all keys (null where a level has none of that name) and the counts.
    """
    rows = df.select("*", *[F.expr(e).alias(f"__k_{k}") for k, e in finest.items()])
    table = bitmaps(rows, [f"__k_{k}" for k in finest], codes)
    table = _written(table.select(*[F.col(f"__k_{k}").alias(k) for k in finest], "counted", "bucket", "bitmap"), "bitmaps")
    every = list(dict.fromkeys([*finest, *[k for _, keys in levels for k in keys]]))
    out = None
    for i, (name, keys) in enumerate(levels):
        if i:
            table = merge(table, [F.expr(e).alias(k) for k, e in keys.items()])
        found = counts(table, list(keys), list(codes))
        have = dict(found.dtypes)
        found = found.select(F.lit(name).alias("level"), *[F.col(k) if k in have else F.lit(None).alias(k) for k in every], *codes)
        out = found if out is None else out.unionByName(found)
    return out
