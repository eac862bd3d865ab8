"""RANGE frames that stay parallel when one partition key holds a large share of the rows.

``agg(x) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN p PRECEDING AND f FOLLOWING)`` depends on a row's key and order
value alone, so peers share one result. For keys above ``hot_fraction`` of the rows:

1. the rows are combined to one row of mergeable states for each (key, order value), which is written; any number of
   equal values costs one row from here on;
2. split points of the order value cut each key into ``buckets`` of about equal numbers of these rows;
3. border replication: a row is also sent to the buckets that hold a value whose frame reaches it, from v - f to v + p.
   Each bucket then has all rows that its own frames need and is a window partition of its own; results of the copies
   are dropped. With frames narrower than a bucket a row has one copy at most, near a border; a frame that spans many
   buckets copies accordingly, and wants fewer of them;
4. the results are joined back by key and order value, a join that AQE splits.

All other keys use the plain window. Null order values are peers of each other alone, as in SQL. Bounds are SQL text:
a number, or an interval for dates and timestamps; ``None`` is the current row and its peers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_location
from .lattice import Measure

#: How the states of a function merge; each is the aggregate of that name over the state columns.
MERGES = {"count": "sum", "sum": "sum", "avg": "sum", "min": "min", "max": "max"}


def _null_safe(left: list[Column], right: list[Column]) -> Column:
    cond = None
    for a, b in zip(left, right, strict=True):
        cond = a.eqNullSafe(b) if cond is None else cond & a.eqNullSafe(b)
    return cond


def _frame(keys: list[str], preceding: str | None, following: str | None) -> str:
    low = f"{preceding} PRECEDING" if preceding else "CURRENT ROW"
    high = f"{following} FOLLOWING" if following else "CURRENT ROW"
    return f"(PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `__v` RANGE BETWEEN {low} AND {high})"


def _written(df: DataFrame, label: str) -> DataFrame:
    where = fresh_location(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _over(m: Measure, frame: str) -> list[Column]:
    return [F.expr(f"{MERGES[m.func]}(`{name}`) OVER {frame}").alias(name) for name, _, _ in m.states()]


def range_window(df: DataFrame, partition_by: list[str], order_by: str, measures: list[Measure], preceding: str | None = None,
                 following: str | None = None, hot_fraction: float = 0.01, buckets: int = 16) -> DataFrame:
    """``df`` with one column for each measure, over the frame around each row's ``order_by`` (ascending) value."""
    for m in measures:
        if m.func not in MERGES:
            raise ValueError(f"no range frame of {m.func!r}")
        if m.output in df.columns:
            raise ValueError(f"the rows already have a column {m.output!r}")
    if not partition_by:
        out = range_window(df.withColumn("__all", F.lit(0)), ["__all"], order_by, measures, preceding, following, hot_fraction, buckets)
        return out.drop("__all")
    keys = list(partition_by)
    rows = df.withColumn("__v", F.expr(order_by))
    frame = _frame(keys, preceding, following)

    # one grouped count gives the total and the hot keys; at most 1 / hot_fraction keys are hot
    counted = _written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "key_counts")
    total = counted.agg(F.sum("__n")).first()[0] or 0
    hot = counted.where(F.col("__n") > max(1, int(total * hot_fraction))).select(*keys)
    hot_rows = hot.collect()

    def plain(part: DataFrame) -> DataFrame:
        named = part.select("*", *[F.expr(_sql(m, frame)).alias(f"__{m.output}") for m in measures])
        return named.select(*df.columns, *[_cast(F.col(f"__{m.output}"), m).alias(m.output) for m in measures])

    if not hot_rows:
        return plain(rows)
    hot = F.broadcast(df.sparkSession.createDataFrame(hot_rows, hot.schema).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]))
    is_hot = _null_safe([F.col(k) for k in keys], [F.col(f"__h{i}") for i in range(len(keys))])
    of_hot = rows.join(hot, is_hot, "left_semi")

    # 1. one row a value
    values = _written(of_hot.groupBy(*keys, "__v").agg(*[b.alias(n) for m in measures for n, b, _ in m.states()]), "frame_states")
    # 2. split points, fixed once
    points = values.groupBy(*keys).agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10000).alias("__splits"))
    splits = df.sparkSession.createDataFrame(points.collect(), points.schema)
    splits = F.broadcast(splits.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], "__splits"))

    def bucket(value: str) -> Column:
        v = F.expr(value)
        return F.size(F.filter(F.coalesce("__splits", F.array().cast(points.schema["__splits"].dataType)), lambda s: v > s))

    # 3. own bucket and those whose frames reach the row
    # sums of floating numbers are rounded: a hair further, so that no bucket lacks a row that its frames reach
    hair = {"double": 1e-12, "float": 1e-5}.get(dict(values.dtypes)["__v"])
    wider = lambda text, bound: f"{text} {'-' if bound == 'low' else '+'} abs(`__v`) * {hair}D" if hair else text
    low = bucket(wider(f"`__v` - {following} * (1 + {hair}D)" if hair else f"`__v` - {following}", "low") if following else "`__v`")
    high = bucket(wider(f"`__v` + {preceding} * (1 + {hair}D)" if hair else f"`__v` + {preceding}", "high") if preceding else "`__v`")
    spread = values.join(splits, is_hot, "left").withColumn("__own", F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(bucket("`__v`")))
    reach = F.when(F.col("__v").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(low, high))
    spread = spread.select(*values.columns, "__own", F.explode(reach).alias("__b"))
    part = _frame([*keys, "__b"], preceding, following)
    done = spread.select(*keys, "__v", "__own", "__b", *[c for m in measures for c in _over(m, part)]).where("__own = __b")
    done = done.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.col("__v").alias("__hv"), *[m.finish() for m in measures])
    # 4. back to the rows
    on = is_hot & F.col("__v").eqNullSafe(F.col("__hv"))
    hot_part = of_hot.join(done, on, "left").select(*df.columns, *[F.col(m.output) for m in measures])
    cold_part = plain(rows.join(hot, is_hot, "left_anti"))
    return cold_part.unionByName(hot_part)


def _cast(c: Column, m: Measure) -> Column:
    return c.cast(m.cast) if m.cast else c


def _sql(m: Measure, frame: str) -> str:
    if m.func == "count":
        return f"count({m.value or '*'}) OVER {frame}"
    if m.func == "avg":  # as the states finish it
        return f"try_divide(CAST(sum({m.value}) OVER {frame} AS DOUBLE), count({m.value}) OVER {frame})"
    return f"{m.func}({m.value}) OVER {frame}"


def from_spec(df: DataFrame, output: str, d: dict) -> DataFrame:
    """A range-frame column described in a job spec: ``{func: "range", agg, value?, partition_by, order_by, preceding?,
    following?, cast?, hot_fraction?, buckets?}``."""
    m = Measure(output, d["agg"], d.get("value"), d.get("cast"))
    return range_window(df, list(d["partition_by"]), d["order_by"], [m], d.get("preceding"), d.get("following"),
                        d.get("hot_fraction", 0.01), d.get("buckets", 16))
