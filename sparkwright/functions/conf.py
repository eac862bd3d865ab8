"""Apply ``key = value`` Spark settings to a running session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE_RE = re.compile(r"^\s*(spark\.[A-Za-z0-9_.\-]+)\s*=\s*(.*?)\s*$")


def parse_settings(lines: list[str] | str) -> list[tuple[str, str]]:
    """Settings from a list of lines, or from any text by keeping the lines that start with ``spark.``."""
    if isinstance(lines, str):
        lines = lines.splitlines()
    out = []
    for line in lines:
        m = _LINE_RE.match(line)
        if m:
            out.append((m.group(1), m.group(2)))
    return out


def apply_settings(spark: SparkSession, lines: list[str] | str) -> dict[str, list[str]]:
    """Set every modifiable SQL setting on the session; report the rest (static, cluster-level) back."""
    applied, skipped = [], []
    for key, value in parse_settings(lines):
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
            applied.append(key)
        else:
            skipped.append(key)
    return {"applied": applied, "skipped": skipped}


def settings_table(texts: DataFrame, text_col: str = "settings") -> DataFrame:
    """One row per setting line of each row's text: the other columns, line (from 0), key, value, modifiable.

    Lines that are no setting have no row, nor has a null text. ``modifiable`` tells whether a running session may set
    the key: of the public settings that Spark lists itself (a bounded list), those that are not static.
    """
    spark = texts.sparkSession
    listed = [r.key for r in spark.sql("SET -v").select("key").collect()]
    known = spark.createDataFrame([(k,) for k in listed if spark.conf.isModifiable(k)], "key string").distinct()
    others = [c for c in texts.columns if c != text_col]
    lines = texts.select(*others, F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("line", "__text"))
    part = lambda i: F.regexp_extract("__text", _LINE_RE.pattern, i)
    rows = lines.where(F.col("__text").rlike(_LINE_RE.pattern)).select(*others, "line", part(1).alias("key"), part(2).alias("value"))
    return rows.join(F.broadcast(known.withColumn("modifiable", F.lit(True))), "key", "left").select(
        *others, "line", "key", "value", F.coalesce("modifiable", F.lit(False)).alias("modifiable"))
