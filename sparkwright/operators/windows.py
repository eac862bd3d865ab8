"""Ordered window columns that stay parallel when one partition key holds a large share of the rows.

A plain ``row_number() OVER (PARTITION BY k ORDER BY ...)`` puts every row of a key in one task, so a key
with a third of the rows is a straggler that AQE cannot split. Here:

1. Keys holding more than ``hot_fraction`` of the rows are found with a two-phase count. At most
   ``1/hot_fraction`` such keys exist, which bounds the broadcast list. With no hot key the plain window
   runs, and the only extra cost is that one narrow counting pass.
2. For each hot key, ``buckets - 1`` split points of the first ordering column are taken with
   ``percentile_approx``, a bounded-memory, partially aggregated sketch. They are fixed once as a small
   table, so recomputed tasks bucket every row the same way. A row's bucket is the number of split points
   it passes. Buckets follow the ordering and keep equal values together, so ties and peers
   never straddle two buckets. Cold keys stay in bucket 0.
   Where the first column can't make the cut (under half of a key's points differ, or a type without quantiles, such
   as text), the split points are whole tuples of the ordering columns instead, picked from a small random
   sample of the key's rows and compared column by column, in each column's own direction and null order.
3. The window runs per ``(key, bucket)``: one shuffle, as for the plain window, but a hot key is now
   ``buckets`` tasks.
4. A small per-(hot key, bucket) summary (row count, sum, last value) gives each bucket the row offset, the
   running-sum offset and the carried-in previous value. It is joined back by broadcast, with the same
   bound as step 1 times ``buckets``.

The supported functions are ``row_number``, ``rank``, ``dense_rank``, the running sum (default RANGE
frame), ``lag(x, k)``, ``lead(x, k)``, and the row count and the sum over a ``ROWS BETWEEN p PRECEDING AND
CURRENT ROW`` frame. For the framed sum, the first p rows of a bucket add the last values of the earlier
buckets, gathered from the bucket tails (at most p rows each). Peers (rows equal on the whole ordering) always share a bucket, so ranks need only the row count,
or the distinct ordering values, of the earlier buckets. With no partition key the whole table is
one hot group, so a global numbering or running total also runs in ``buckets`` tasks instead of one. Results equal the plain window. Where
the ordering has ties, any tie order that the plain window could also have produced is valid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FUNCS = ("row_number", "rank", "dense_rank", "running_sum", "lag", "lead", "rows_count", "rows_sum")


@dataclass(frozen=True)
class WinOut:
    func: str            # "row_number" | "rank" | "dense_rank" | "running_sum" | "lag" | "lead" | "rows_count"
    output: str
    value: str | None = None   # SQL expression summed / lagged
    preceding: int = 0         # rows_count / rows_sum: frame of `preceding` rows before the current one
    cast: str | None = None    # optional output type
    offset: int = 1            # lag / lead: how many rows back or ahead


def _order_cols(order_by: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order_by]


def _null_safe_on(cols: list[str], left: str, right: str) -> Column:
    cond = None
    for c in cols:
        term = F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        cond = term if cond is None else cond & term
    return cond


_SKETCHABLE = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _sketchable(dtype: str) -> bool:
    """Types ``percentile_approx`` takes as they are. Split points then compare in the column's own
    order, with no conversion through a time zone or to floating point."""
    return dtype in _SKETCHABLE or dtype.startswith("decimal")


def _plain(df: DataFrame, w, outputs: list[WinOut]) -> DataFrame:
    cols = []
    for o in outputs:
        if o.func == "row_number":
            c = F.row_number().over(w)
        elif o.func == "rank":
            c = F.rank().over(w)
        elif o.func == "dense_rank":
            c = F.dense_rank().over(w)
        elif o.func == "lead":
            c = F.lead(F.expr(o.value), o.offset).over(w)
        elif o.func == "rows_count":
            c = F.count(F.lit(1)).over(w.rowsBetween(-o.preceding, 0))
        elif o.func == "rows_sum":
            c = F.sum(F.expr(o.value)).over(w.rowsBetween(-o.preceding, 0))
        elif o.func == "running_sum":
            c = F.sum(F.expr(o.value)).over(w)
        else:
            c = F.lag(F.expr(o.value), o.offset).over(w)
        cols.append((c.cast(o.cast) if o.cast else c).alias(o.output))
    return df.select("*", *cols)


def hot_keys(df: DataFrame, keys: list[str], hot_fraction: float) -> list:
    """Key values holding more than ``hot_fraction`` of the rows: at most ``1/hot_fraction`` of them exist,
    so they come back to the driver as a small, fixed list."""
    total = df.count()
    threshold = max(1, int(total * hot_fraction))
    rows = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
              .filter(F.col("__n") > threshold).select(*keys).collect())
    if len(rows) > max(1, int(1 / hot_fraction)):
        raise RuntimeError("more hot keys than the bound allows")
    return rows


#: Sampled rows for each bucket of a hot key when split points are tuples.
SAMPLE_PER_BUCKET = 64


def _tuple_splits(d: DataFrame, hot: DataFrame, keys: list[str], order_by: list[tuple[str, bool]], buckets: int):
    """(rows, schema): per hot key, up to ``buckets - 1`` tuples of its ordering columns, in order.

    The sample holds about ``SAMPLE_PER_BUCKET`` rows a bucket whatever the key's size, so sorting it is bounded.
    Any sample gives right results, only the balance depends on it; the points are fixed once they are collected.
    """
    rows = d.join(F.broadcast(hot.alias("__h")), _null_safe_on(keys, "__d", "__h"), "left_semi")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sizes = F.broadcast(d.sparkSession.createDataFrame(sizes.collect(), sizes.schema).alias("__c"))
    names = [f"__t{i}" for i in range(len(order_by))]
    picked = (rows.join(sizes, _null_safe_on(keys, "__d", "__c"))
              .where(F.rand(0) * F.col("__c.__n") < SAMPLE_PER_BUCKET * buckets)
              .select(*[F.col(f"__d.{k}") for k in keys], *[F.col(f"__d.{c}").alias(n) for (c, _), n in zip(order_by, names)]))
    per_key = Window.partitionBy(*keys)
    ordered = per_key.orderBy(*_order_cols([(n, asc) for n, (_, asc) in zip(names, order_by)]))
    placed = picked.withColumn("__rn", F.row_number().over(ordered)).withColumn("__m", F.count(F.lit(1)).over(per_key))
    edge = F.floor(F.col("__rn") * buckets / F.col("__m")) > F.floor((F.col("__rn") - 1) * buckets / F.col("__m"))
    points = placed.where(edge & (F.col("__rn") < F.col("__m"))).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("__rn", F.struct(*names).alias("__t")))).alias("__p"))
    points = points.select(*keys, F.transform("__p", lambda p: p["__t"]).alias("__splits"))
    return points.collect(), points.schema


def _after(row: list[Column], split, order_by: list[tuple[str, bool]]) -> Column:
    """Whether a row's ordering tuple comes after a split tuple: first columns first, nulls as in ``_order_cols``."""
    cond = F.lit(False)
    for i in range(len(order_by) - 1, -1, -1):
        a, b, asc = row[i], split[f"__t{i}"], order_by[i][1]
        if asc:
            later = F.when(a.isNull(), F.lit(False)).when(b.isNull(), F.lit(True)).otherwise(a > b)
        else:
            later = F.when(b.isNull(), F.lit(False)).when(a.isNull(), F.lit(True)).otherwise(a < b)
        cond = later | (a.eqNullSafe(b) & cond)
    return cond


def skew_safe_window(df: DataFrame, partition_by: list[str], order_by: list[tuple[str, bool]],
                     outputs: list[WinOut], hot_fraction: float = 0.01, buckets: int = 16,
                     accuracy: int = 10000, hot_rows: list | None = None) -> DataFrame:
    """Add the ``outputs`` window columns to ``df`` (all input columns kept). An output named like an
    input column replaces it in place, as ``withColumn`` does, after the window has read the old values."""
    taken = set(df.columns)
    if any(o.output in taken for o in outputs):
        tmp = [WinOut(o.func, f"__out{i}", o.value, o.preceding, o.cast, o.offset) for i, o in enumerate(outputs)]
        res = skew_safe_window(df, partition_by, order_by, tmp, hot_fraction, buckets, accuracy, hot_rows)
        for i, o in enumerate(outputs):
            res = res.withColumn(o.output, F.col(f"__out{i}"))
        return res.drop(*[f"__out{i}" for i in range(len(outputs))])
    if not order_by:
        raise ValueError("an ordered window needs order_by")
    if not partition_by:
        # a window over the whole table is one group holding every row: split it like any hot key, so the
        # numbering runs in ``buckets`` tasks instead of one
        out = skew_safe_window(df.withColumn("__all", F.lit(0)), ["__all"], order_by, outputs,
                               hot_fraction, buckets, accuracy)
        return out.drop("__all")
    for o in outputs:
        if o.func not in FUNCS:
            raise ValueError(f"unsupported window function {o.func!r}")
    first, first_asc = order_by[0]
    keys = list(partition_by)
    dtype = dict(df.dtypes)[first]

    # 1. hot keys (bounded by construction, so they may be fixed as a small literal table)
    if hot_rows is None:
        hot_rows = hot_keys(df, keys, hot_fraction)
    if not hot_rows:
        # nothing to split: the plain window is already balanced
        w = Window.partitionBy(*keys).orderBy(*_order_cols(order_by))
        return _plain(df, w, outputs)
    hot = df.sparkSession.createDataFrame(hot_rows, df.select(*keys).schema)

    # 2. split points of the first ordering column, per hot key
    probs = [i / buckets for i in range(1, buckets)]
    d = df.alias("__d")
    sort_v = F.col(first)
    rows = None
    if _sketchable(dtype):
        sketch = (d.join(F.broadcast(hot.alias("__h")), _null_safe_on(keys, "__d", "__h"), "left_semi")
                    .groupBy(*keys).agg(F.percentile_approx(sort_v, probs, accuracy).alias("__splits")))
        # The split points are fixed once, as a small literal table: a sketch recomputed after a lost executor
        # could place them differently, and the bucketing and the summary below must agree on every row.
        rows, schema = sketch.collect(), sketch.schema
        if buckets > 1 and len(order_by) > 1 and any(len(set(r["__splits"] or ())) < buckets // 2 for r in rows):
            rows = None
    v = F.col("__v")
    passed = (F.filter(F.col("__splits"), lambda s: v > s) if first_asc
              else F.filter(F.col("__splits"), lambda s: v < s))
    whole = rows is None
    if whole:   # whole tuples, for every hot key
        rows, schema = _tuple_splits(d, hot, keys, order_by, buckets)
        passed = F.filter(F.col("__splits"), lambda s: _after([F.col(c) for c, _ in order_by], s, order_by))
    splits = F.broadcast(df.sparkSession.createDataFrame(rows, schema).alias("__s"))

    place = (F.when(F.col("__hot"), F.size(passed)).otherwise(F.lit(0)) if whole
             else F.when(F.col("__hot") & v.isNotNull(), F.size(passed))
                   .when(F.col("__hot") & first_asc, F.lit(0))
                   .when(F.col("__hot"), F.lit(buckets - 1))
                   .otherwise(F.lit(0)))
    bucketed = (d.join(splits, _null_safe_on(keys, "__d", "__s"), "left")
                  .select(*[F.col(f"__d.{c}") for c in df.columns], F.col("__s.__splits").alias("__splits"))
                  .withColumn("__v", sort_v)
                  .withColumn("__hot", F.col("__splits").isNotNull())
                  .withColumn("__b", place)
                  .drop("__splits", "__v"))

    # 3. the window per (key, bucket)
    w = Window.partitionBy(*keys, "__b").orderBy(*_order_cols(order_by))
    local = bucketed.withColumn("__rn", F.row_number().over(w))
    for o in outputs:
        if o.func == "running_sum":
            local = local.withColumn(f"__sum_{o.output}", F.sum(F.expr(o.value)).over(w))
        elif o.func == "lag":
            local = local.withColumn(f"__lag_{o.output}", F.lag(F.expr(o.value), o.offset).over(w))
        elif o.func == "lead":
            local = local.withColumn(f"__lead_{o.output}", F.lead(F.expr(o.value), o.offset).over(w))
        elif o.func == "rank":
            local = local.withColumn(f"__rank_{o.output}", F.rank().over(w))
        elif o.func == "dense_rank":
            local = local.withColumn(f"__drank_{o.output}", F.dense_rank().over(w))
        elif o.func == "rows_sum":
            local = local.withColumn(f"__rsum_{o.output}", F.sum(F.expr(o.value)).over(w.rowsBetween(-o.preceding, 0)))
    frames = [o for o in outputs if o.func == "rows_sum"]
    far = [o for o in outputs if o.func in ("lag", "lead") and o.offset > 1]
    if frames or far:
        local = local.withColumn("__bsize", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__b")))

    # 4. per-(hot key, bucket) summary -> offsets, joined back by broadcast
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    ord_struct = F.struct(*[F.col(c) for c, _ in order_by])
    # with mixed directions a struct's own order is not the window's: a bucket's ends are told by row numbers
    mixed = any(asc != first_asc for _, asc in order_by)
    by, up = (F.col("__rn"), True) if mixed else (ord_struct, first_asc)
    for o in outputs:
        if o.func == "running_sum":
            aggs.append(F.sum(F.expr(o.value)).alias(f"__bsum_{o.output}"))
        elif o.func == "lag":
            pick = F.max_by if up else F.min_by
            aggs.append(pick(F.expr(o.value), by).alias(f"__blast_{o.output}"))
        elif o.func == "lead":
            pick = F.min_by if up else F.max_by
            aggs.append(pick(F.expr(o.value), by).alias(f"__bfirst_{o.output}"))
        elif o.func == "dense_rank":
            aggs.append(F.count_distinct(ord_struct).alias(f"__bdist_{o.output}"))
    ends = mixed and any(o.func in ("lag", "lead") for o in outputs)
    summary = (local if ends else bucketed).filter("__hot").groupBy(*keys, "__b").agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy("__b")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    offs = summary.select(*keys, "__b", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
                          *[F.sum(f"__bsum_{o.output}").over(before).alias(f"__osum_{o.output}")
                            for o in outputs if o.func == "running_sum"],
                          *[F.lag(f"__blast_{o.output}", 1).over(ws).alias(f"__carry_{o.output}")
                            for o in outputs if o.func == "lag"],
                          *[F.lead(f"__bfirst_{o.output}", 1).over(ws).alias(f"__next_{o.output}")
                            for o in outputs if o.func == "lead"],
                          *[F.coalesce(F.sum(f"__bdist_{o.output}").over(before), F.lit(0)).alias(f"__doff_{o.output}")
                            for o in outputs if o.func == "dense_rank"],
                          F.col("__cnt").alias("__bcnt"))
    offs = F.broadcast(offs.alias("__o"))
    lo = local.alias("__l")
    joined = lo.join(offs, _null_safe_on(keys + ["__b"], "__l", "__o"), "left")
    out = joined.select(*[F.col(f"__l.{c}") for c in local.columns],
                        *[F.col(f"__o.{c}") for c in offs.columns if c not in keys + ["__b"]])
    for o in frames:
        # the last p values of every earlier bucket, in order: from the bucket tails (at most p rows each)
        p_ = o.preceding
        tails = (local.filter(F.col("__hot") & (F.col("__rn") > F.col("__bsize") - p_))
                 .select(*keys, "__b", "__rn", F.expr(o.value).alias("__v")))
        per_key = tails.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "__rn", "__v"))).alias("__t"))
        buckets_of = tails.select(*keys, "__b").distinct().alias("__x")
        carry = (buckets_of.join(per_key.alias("__y"), _null_safe_on(keys, "__x", "__y"))  # a hot key may be null
                 .select(*[F.col(f"__x.{k}") for k in keys], F.col("__x.__b"), F.col("__y.__t"))
                 .withColumn("__prev", F.filter("__t", lambda x: x["__b"] < F.col("__b")))
                 .select(*keys, "__b", F.transform(F.slice("__prev", F.greatest(F.size("__prev") - p_ + 1, F.lit(1)),
                                                            p_), lambda x: x["__v"]).alias(f"__c_{o.output}")))
        out = (out.alias("__m").join(F.broadcast(carry.alias("__k")), _null_safe_on(keys + ["__b"], "__m", "__k"),
                                     "left")
               .select(*[F.col(f"__m.{c}") for c in out.columns], F.col(f"__k.__c_{o.output}")))
    for o in far:
        # lag k: the last k values of the earlier buckets; lead k: the first k values of the later ones
        k_ = o.offset
        edge = (F.col("__rn") > F.col("__bsize") - k_) if o.func == "lag" else (F.col("__rn") <= k_)
        rows_ = (local.filter(F.col("__hot") & edge)
                 .select(*keys, "__b", "__rn", F.expr(o.value).alias("__v")))
        per_key = rows_.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "__rn", "__v"))).alias("__t"))
        bk = local.filter(F.col("__hot")).select(*keys, "__b").distinct().alias("__x")
        picked = (F.filter("__t", lambda x: x["__b"] < F.col("__b")) if o.func == "lag"
                  else F.filter("__t", lambda x: x["__b"] > F.col("__b")))
        near = (F.slice(picked, F.greatest(F.size(picked) - k_ + 1, F.lit(1)), k_) if o.func == "lag"
                else F.slice(picked, 1, k_))
        carry_k = (bk.join(per_key.alias("__y"), _null_safe_on(keys, "__x", "__y"))
                   .select(*[F.col(f"__x.{k}") for k in keys], F.col("__x.__b"),
                           F.transform(near, lambda x: x["__v"]).alias(f"__k_{o.output}")))
        out = (out.alias("__m").join(F.broadcast(carry_k.alias("__q")), _null_safe_on(keys + ["__b"], "__m", "__q"),
                                     "left")
               .select(*[F.col(f"__m.{c}") for c in out.columns], F.col(f"__q.__k_{o.output}")))
    rn = F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))
    for o in outputs:
        if o.func == "row_number":
            out = out.withColumn(o.output, rn.cast("int"))
        elif o.func == "rows_count":
            out = out.withColumn(o.output, F.least(rn, F.lit(o.preceding + 1)).cast("bigint"))
        elif o.func == "running_sum":
            local_sum = F.col(f"__sum_{o.output}")
            carry = F.col(f"__osum_{o.output}")
            out = out.withColumn(o.output, F.when(carry.isNull(), local_sum).otherwise(
                F.when(local_sum.isNull(), carry).otherwise(local_sum + carry)))
        elif o.func == "lag" and o.offset > 1:
            c = F.col(f"__k_{o.output}")
            idx = F.size(c) - F.lit(o.offset) + F.col("__rn")      # position in the carried values, 1-based
            from_carry = (F.col("__rn") <= o.offset) & c.isNotNull() & (idx >= 1)
            out = out.withColumn(o.output, F.when(F.col("__rn") > o.offset, F.col(f"__lag_{o.output}"))
                                 .when(from_carry, F.element_at(c, F.greatest(idx, F.lit(1)).cast("int"))))
        elif o.func == "lead" and o.offset > 1:
            c = F.col(f"__k_{o.output}")
            idx = F.lit(o.offset) - (F.col("__bsize") - F.col("__rn"))   # how far past the bucket's end
            from_carry = (idx >= 1) & c.isNotNull() & (idx <= F.size(c))
            out = out.withColumn(o.output, F.when(idx < 1, F.col(f"__lead_{o.output}"))
                                 .when(from_carry, F.element_at(c, F.greatest(idx, F.lit(1)).cast("int"))))
        elif o.func == "lag":
            out = out.withColumn(o.output, F.when(F.col("__rn") == 1, F.col(f"__carry_{o.output}"))
                                 .otherwise(F.col(f"__lag_{o.output}")))
        elif o.func == "lead":
            # a bucket's last row takes the first value of the next bucket (cold keys: one bucket, no next)
            last = F.col("__bcnt").isNotNull() & (F.col("__rn") == F.col("__bcnt"))
            out = out.withColumn(o.output, F.when(last, F.col(f"__next_{o.output}"))
                                 .otherwise(F.col(f"__lead_{o.output}")))
        elif o.func == "rank":
            out = out.withColumn(o.output, (F.col(f"__rank_{o.output}") + F.coalesce(F.col("__off"), F.lit(0)))
                                 .cast("int"))
        elif o.func == "rows_sum":
            # rows near a bucket's start add the last (p - rn + 1) values carried from earlier buckets,
            # summed in the same type as the window's own sum (exact for decimals), nulls skipped
            k = F.lit(o.preceding) - F.col("__rn") + 1
            c = F.col(f"__c_{o.output}")
            take = F.greatest(F.least(k, F.size(c)), F.lit(0))     # never negative, whatever is evaluated
            carried = F.filter(F.slice(c, F.greatest(F.size(c) - take + 1, F.lit(1)), take),
                               lambda x: x.isNotNull())
            sum_type = df.select(F.sum(F.expr(o.value)).alias("s")).schema["s"].dataType
            extra = F.when((k > 0) & c.isNotNull() & (F.size(carried) > 0),
                           F.aggregate(carried, F.lit(0).cast(sum_type), lambda acc, x: (acc + x).cast(sum_type)))
            local_sum = F.col(f"__rsum_{o.output}")
            out = out.withColumn(o.output, F.when(extra.isNull(), local_sum)
                                 .when(local_sum.isNull(), extra).otherwise(local_sum + extra))
        elif o.func == "dense_rank":
            out = out.withColumn(o.output, (F.col(f"__drank_{o.output}")
                                            + F.coalesce(F.col(f"__doff_{o.output}"), F.lit(0))).cast("int"))
    return out.select(*df.columns, *[F.col(o.output).cast(o.cast) if o.cast else F.col(o.output)
                                      for o in outputs])


def from_spec(df: DataFrame, entries: list[tuple[str, dict]]) -> DataFrame:
    """Window columns described in a job spec: ``[(output_column, skew_safe dict)]``, where the dict holds
    ``partition_by``, ``order_by`` (``[[col, "asc"|"desc"], ...]``), ``func``, and optionally ``value``,
    ``preceding``, ``cast``, ``hot_fraction``, ``buckets``. Entries sharing partition and order run as one
    window."""
    groups: dict[tuple, list[tuple[WinOut, dict]]] = {}
    for out, d in entries:
        order = tuple((c, str(dirn).lower() != "desc") for c, dirn in d["order_by"])
        key = (tuple(d["partition_by"]), order, d.get("hot_fraction", 0.01), d.get("buckets", 16))
        groups.setdefault(key, []).append((WinOut(d["func"], out, d.get("value"), int(d.get("preceding", 0)),
                                                  d.get("cast"), int(d.get("offset", 1))), d))
    probed: dict[tuple, list] = {}
    for (parts, order, frac, nb), outs in groups.items():
        # groups over the same keys and share reuse one hot-key probe; the input rows are the same, since
        # window outputs only add columns
        if parts and (parts, frac) not in probed:
            probed[(parts, frac)] = hot_keys(df, list(parts), frac)
        df = skew_safe_window(df, list(parts), list(order), [o for o, _ in outs], hot_fraction=frac, buckets=nb,
                              hot_rows=probed.get((parts, frac)))
    return df
