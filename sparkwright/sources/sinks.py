"""Sinks: preview (S5), overwrite (S6), append (S7), static-partition write (S8), replace only the written
partitions (S9) and insert with a column list (S10).

Writes are single Spark jobs straight from the executors to the table location; nothing passes the driver.
A table is registered in the session catalog and, when a ``path`` is given, lives at that path (an external
table), so a rerun never trips over a leftover managed-table folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITE_MODES = ("overwrite", "append")


@dataclass
class Target:
    table: str
    schema: str | None = None
    path: str | None = None
    mode: str = "overwrite"
    # (column, value) pairs; a value of None makes the column a dynamic partition column
    partitions: list[tuple[str, str | None]] = field(default_factory=list)
    replace_partitions: bool = False   # S9: overwrite only the partitions being written
    columns: list[str] | None = None   # S10: insert into these target columns, by name
    format: str | None = None          # None: the session's default source (spark.sql.sources.default)
    # REBALANCE on the dynamic partition columns before writing; None = only when there are dynamic ones
    rebalance: bool | None = None
    # rows hashed to files by these keys, so that joins and aggregates on them need no shuffle; see bucketed
    bucket_by: list[str] | None = None
    buckets: int | None = None         # None: by the measured size of the rows
    sort_by: list[str] | None = None   # order within each bucket; None: the bucket keys

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table


#: Size a bucket aims at when their number is not given.
BUCKET_BYTES = 128 << 20


def bucket_count(df: DataFrame, target_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets for rows of this size: a power of two, so that tables of other sizes have a multiple of it or a
    divisor, which Spark can still join bucket by bucket."""
    from ..operators.joins import measure

    _, size = measure(df)
    n = 1
    while n * target_bytes < size:
        n *= 2
    return n


def bucketed(df: DataFrame, target: Target) -> tuple[DataFrame, int]:
    """The rows dealt to one task a bucket, as the writer deals them, and the number of buckets.

    Without that each task writes a file for every bucket it has rows of. A key with more rows than a bucket should hold
    makes its bucket that large: such a table is better left unbucketed and joined with salted keys.
    """
    keys = target.bucket_by or []
    unknown = [k for k in [*keys, *(target.sort_by or [])] if k not in df.columns]
    if unknown or not keys:
        raise ValueError(f"bucket and sort keys must be columns of the rows: {unknown or keys}")
    n = target.buckets or bucket_count(df)
    if n < 1:
        raise ValueError("a table needs at least one bucket")
    return df.repartition(n, *keys), n


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (S5). With an order this is a top-k (``TakeOrderedAndProject``), not a full sort."""
    if order_by:
        df = df.orderBy(*[F.expr(c) for c in order_by])
    return df.limit(n)


def with_static_partitions(df: DataFrame, partitions: list[tuple[str, str | None]],
                           types: dict[str, str] | None = None) -> DataFrame:
    """Each ``column=value`` pair becomes a literal column (D13, D14), of the type that ``types`` names, else a
    string. A column that the rows already have is an error, as in ``INSERT .. PARTITION``: the literal would
    overwrite its values."""
    have = {c.lower() for c in df.columns}
    for col, val in partitions:
        if val is not None:
            if col.lower() in have:
                raise ValueError(f"static partition column {col!r} is already a column of the rows")
            df = df.withColumn(col, F.lit(val).cast((types or {}).get(col.lower(), "string")))
    return df


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write(df: DataFrame, target: Target) -> str:
    """Write ``df`` to the target table; returns the qualified table name."""
    spark = df.sparkSession
    if target.mode not in WRITE_MODES:
        raise ValueError(f"write mode must be one of {WRITE_MODES}, not {target.mode!r}")
    # an existing table says what type its partition columns have
    known = {c.lower(): t for c, t in spark.read.table(target.qualified).dtypes} if table_exists(spark, target.qualified) else {}
    df = with_static_partitions(df, target.partitions, known)
    part_cols = [c for c, _ in target.partitions]
    dynamic = [c for c, v in target.partitions if v is None]
    if target.rebalance or (target.rebalance is None and dynamic):
        # without this, every task writes one file per partition value it holds (tasks x values files);
        # REBALANCE lets AQE size the write tasks, splitting a skewed value and coalescing small ones
        df = df.hint("rebalance", *dynamic)
    name = target.qualified
    if target.schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{target.schema}`")
    if target.columns is not None:
        return insert_columns(df, target)
    if target.replace_partitions:
        if not part_cols:
            raise ValueError("replace_partitions needs partition columns")
        if table_exists(spark, name):
            cols = spark.read.table(name).columns
            # insertInto reads the mode from the session, so set it for this one insert only
            key = "spark.sql.sources.partitionOverwriteMode"
            old = spark.conf.get(key)
            spark.conf.set(key, "dynamic")
            try:
                df.select(*cols).write.insertInto(name, overwrite=True)
            finally:
                spark.conf.set(key, old)
            return name
    buckets = 0
    if target.bucket_by:
        df, buckets = bucketed(df, target)
    w = df.write.mode(target.mode)
    if target.format:
        w = w.format(target.format)
    if part_cols:
        w = w.partitionBy(*part_cols)
    if target.path:
        w = w.option("path", target.path)
    if target.bucket_by:
        w = w.bucketBy(buckets, *target.bucket_by).sortBy(*(target.sort_by or target.bucket_by))
    w.saveAsTable(name)
    return name


def create_table(spark: SparkSession, name: str, ddl_columns: str, path: str | None = None,
                 fmt: str = "parquet", partitioned_by: list[str] | None = None) -> None:
    loc = f" LOCATION '{path}'" if path else ""
    part = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl_columns}) USING {fmt}{part}{loc}")


def insert_columns(df: DataFrame, target: Target) -> str:
    """``INSERT INTO t (c1, .., ck) SELECT ..``: the i-th select column goes to the i-th listed target
    column; target columns not listed get null. ``insertInto`` is positional, so the frame is first put in
    the table's column order."""
    spark = df.sparkSession
    name = target.qualified
    cols = target.columns or []
    if len(cols) != len(df.columns):
        raise ValueError(f"{len(cols)} target columns for {len(df.columns)} values")
    fields = spark.read.table(name).schema.fields
    by_target = dict(zip([c.lower() for c in cols], df.columns))
    unknown = set(by_target) - {f.name.lower() for f in fields}
    if unknown:
        raise ValueError(f"columns not in {name}: {sorted(unknown)}")
    ordered = [F.col(by_target[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in by_target
               else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    df.select(*ordered).write.insertInto(name, overwrite=(target.mode == "overwrite"))
    return name
