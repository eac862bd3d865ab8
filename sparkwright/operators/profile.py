"""Heavy hitters of every column at once (K14), exact, from two scans.

A key's skew is told by its most frequent values. Counting every value of every column costs a shuffle of each column's
distinct values. Here the first scan keeps, for each column, a frequent-items summary of bounded size in each task, and
merges them (``approx_top_k``); any value with more than a ``share`` of the rows is among its candidates for certain,
since the summary's error is far below the share. The second scan counts the candidates exactly, at most some
``1 / share`` a column, and drops those below the share. Neither scan shuffles rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a summary tracks; its counts are off by at most about 3.5 / TRACKED of the rows.
TRACKED = 10_000

_TYPES = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "string")


def candidates(df: DataFrame, columns: list[str], share: float) -> dict[str, list]:
    """For each column, the values that may hold at least ``share`` of the rows; every such value is among them."""
    error = 3.5 / TRACKED
    if not 4 * error < share <= 1:
        raise ValueError(f"the share must be above {4 * error:g} and at most 1")
    most = math.ceil(1 / (share - error)) + 1
    types = dict(df.dtypes)
    for c in columns:
        if types[c] not in _TYPES and not types[c].startswith("decimal"):
            raise ValueError(f"no profile of column {c!r} of type {types[c]}")
    found = df.agg(*[F.expr(f"approx_top_k(`{c}`, {most}, {TRACKED})").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    # a null is counted by itself below
    return {c: [r["item"] for r in found[f"c{i}"] or [] if r["item"] is not None] for i, c in enumerate(columns)}


def column_profile(df: DataFrame, columns: list[str] | None = None, share: float = 0.05) -> DataFrame:
    """``column_name, value, n, n_rows``: one row for each column and value (as text; null for nulls) that holds at least
    ``share`` of the rows, counted exactly. The candidates, at most some ``1 / share`` a column, pass the driver."""
    columns = columns or df.columns
    wanted = [(c, v) for c, values in candidates(df, columns, share).items() for v in [*values, None]]
    kinds = {f.name: f.dataType for f in df.schema}
    literals = [F.lit(v).cast(kinds[c]) for c, v in wanted]
    hits = [F.count_if(F.col(f"`{c}`").eqNullSafe(v)).alias(f"h{i}") for i, ((c, _), v) in enumerate(zip(wanted, literals, strict=True))]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *hits)
    row = counted.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), v.cast("string").alias("value"), F.col(f"h{i}").alias("n")) for i, ((c, _), v) in enumerate(zip(wanted, literals, strict=True))])))
    out = row.where((F.col("n") > 0) & (F.col("n") >= F.lit(share) * F.col("n_rows")))
    return out.select("column_name", "value", F.col("n").cast("bigint").alias("n"), F.col("n_rows").cast("bigint").alias("n_rows"))
