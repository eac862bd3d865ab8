"""Run a job spec as one lazy DataFrame plan.

Order, as the spec denotes it: scans with their predicates -> left-deep join chain from the first table ->
global predicate -> transformations -> (optional) write. Nothing is collected; the only actions are the
write itself and the bounded size probe of a ``broadcast`` join step.

When the spec has a target, the result is written once and the returned DataFrame reads the written table,
so a preview or a count afterwards does not recompute the joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conf import apply_settings
from ..operators.joins import Chain, fits_broadcast, spark_join_type
from ..operators.transforms import apply_transformations, only_adds_columns
from ..sources.sinks import write
from ..sources.tables import Resolver, catalog_or_path, scan, subquery
from .spec import JobSpec, parse_spec


def build_frame(spark: SparkSession, spec: dict | str | JobSpec, resolver: Resolver = catalog_or_path,
                views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The spec's result as a lazy DataFrame, without writing."""
    js = spec if isinstance(spec, JobSpec) else parse_spec(spec)
    if js.settings:
        apply_settings(spark, js.settings)
    frames = {t.alias: scan(spark, t.name, schema=t.schema, path=t.path, alias=t.alias,
                            predicate=t.predicate, resolver=resolver) for t in js.tables}
    bindable = dict(views or {})
    bindable.update(frames)

    first = js.tables[0].alias
    chain = Chain.of(frames[first], first)
    for i, j in enumerate(js.joins):
        if j.type == "subquery":
            alias = j.right_alias or f"sq{i}"
            right = subquery(spark, j.subquery, bindable, alias=alias)
            right = _maybe_broadcast(right, j.strategy)
            chain = chain.join(right, alias, j.conditions, "inner")
        elif j.type == "self":
            chain = chain.self_join(j.left_alias, j.right_alias, j.conditions)
        else:
            right = frames[j.right_table]
            if j.strategy == "salted" and spark_join_type(j.type) in ("right", "full"):
                opts = dict(j.salt or {})
                chain = chain.join_salted_outer(right, j.right_table, spark_join_type(j.type),
                                                opts["left_keys"], opts["right_keys"], salts=int(opts.get("salts", 8)),
                                                salt_from=opts.get("salt_from"), hot_fraction=opts.get("hot_fraction"),
                                                skewed_side=opts.get("skewed_side", "left"))
            elif j.strategy == "salted":
                opts = dict(j.salt or {})
                # the keys carry the equality; any join text is kept as further terms, never dropped
                extra = " AND ".join(f"({t})" for t in (j.conditions, opts.get("condition")) if t and t.strip())
                chain = chain.join_salted(right, j.right_table, extra or None, j.type,
                                          left_keys=opts["left_keys"], right_keys=opts["right_keys"],
                                          salts=int(opts.get("salts", 8)), salt_from=opts.get("salt_from"),
                                          hot_fraction=opts.get("hot_fraction"),
                                          skewed_side=opts.get("skewed_side", "left"))
            elif j.strategy in ("grid", "overlap"):
                chain = chain.join_theta(right, j.right_table, j.conditions, j.theta)
            elif j.strategy == "band":
                b = j.band
                width = b["width"] if b["width"] == "auto" else float(b["width"])
                chain = chain.join_band(right, j.right_table, j.conditions, b["low"], b["high"], b["point"],
                                        width, b.get("range_side", "left"))
            else:
                chain = chain.join(_maybe_broadcast(right, j.strategy), j.right_table, j.conditions, j.type)

    df = chain.df
    if js.predicates and js.predicates.strip():
        df = df.filter(F.expr(js.predicates))
        chain = Chain(df, chain.cols)
    if js.transformations:
        before = df.columns
        df = apply_transformations(df, js.transformations, js.having)
        if only_adds_columns(js.transformations):
            # every input column stays: keep their origins, the new columns are unqualified
            added = [("", c) for c in df.columns[len(before):]]
            df = Chain(df, chain.cols + added).flattened().df
    else:
        df = chain.flattened().df
    return df


def _maybe_broadcast(df: DataFrame, strategy: str | None) -> DataFrame:
    if strategy == "broadcast" and fits_broadcast(df):
        return F.broadcast(df)
    return df


def run_job(spark: SparkSession, spec: dict | str | JobSpec, resolver: Resolver = catalog_or_path,
            views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Build the spec's frame; write it when the spec names a target and return the written table."""
    js = spec if isinstance(spec, JobSpec) else parse_spec(spec)
    df = build_frame(spark, js, resolver, views)
    if js.target is None:
        return df.limit(js.preview) if js.preview else df
    name = write(df, js.target)
    out = spark.read.table(name)
    return out.limit(js.preview) if js.preview else out
