"""Scans (S1), aliases (S2), SQL subquery sources (S3) and per-table predicates.

Every source stays a lazy DataFrame: the per-table predicate is a plain ``filter`` so that Catalyst pushes it
into the Parquet scan (``PushedFilters``) and prunes the columns nobody reads (``ReadSchema``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A resolver turns (schema, name, path) into an unfiltered DataFrame.
Resolver = Callable[[SparkSession, str | None, str, str | None], DataFrame]


def catalog_or_path(spark: SparkSession, schema: str | None, name: str, path: str | None) -> DataFrame:
    """Default resolver: an explicit Parquet path wins, else the catalog table ``schema.name``."""
    if path:
        return spark.read.parquet(path)
    return spark.read.table(f"{schema}.{name}" if schema else name)


def parquet_dir_resolver(base_dir: str) -> Resolver:
    """Resolve bare table names to ``<base_dir>/<name>.parquet`` (the driver's test tables)."""
    base = base_dir.rstrip("/")

    def resolve(spark: SparkSession, schema: str | None, name: str, path: str | None) -> DataFrame:
        if path:
            return spark.read.parquet(path)
        return spark.read.parquet(f"{base}/{name}.parquet")

    return resolve


def scan(spark: SparkSession, name: str, *, schema: str | None = None, path: str | None = None,
         alias: str | None = None, predicate: str | None = None,
         resolver: Resolver = catalog_or_path) -> DataFrame:
    """One table entry of a job spec: read, filter (if the predicate is non-blank), alias."""
    # aliased first, so the predicate may name columns either bare or as alias.column
    df = resolver(spark, schema, name, path).alias(alias or name)
    if predicate and predicate.strip():
        df = df.filter(F.expr(predicate))
    return df


def subquery(spark: SparkSession, text: str, frames: Mapping[str, DataFrame] | None = None,
             alias: str | None = None) -> DataFrame:
    """Arbitrary ``SELECT`` text as a frame.

    ``{name}`` placeholders in the text are bound to the given DataFrames through ``spark.sql``'s own
    parameter mechanism, so the subquery reads the same (already filtered) sources as the rest of the job.
    Names without braces resolve through the catalog.
    """
    frames = dict(frames or {})
    used = {k: v for k, v in frames.items() if "{" + k + "}" in text}
    if used:  # any other brace is text of the query, such as a count in a pattern
        parts = re.split("(" + "|".join(re.escape("{" + k + "}") for k in used) + ")", text)
        text = "".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))
    df = spark.sql(text, **used) if used else spark.sql(text)
    return df.alias(alias) if alias else df
