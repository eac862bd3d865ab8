"""Transformation routing: group keys, aggregates, select items, added columns, windows.

A transformation entry is ``{output_column, expression, kind?}``. Without an explicit ``kind`` its role is
inferred from the text:

* ``group by a, b``                     -> group keys (comma list at top level, case kept; D4)
* an ``over (`` window                  -> a ``column`` when no select item exists, else a ``select`` item
* ``sum( avg( count( max( min(``        -> aggregate (word boundary, so ``checksum(`` is not one; D7)
* anything else                         -> select item

Then, as one lazy step:

* keys and aggregates          -> ``groupBy(keys).agg(...)`` (A1-A9)
* keys only                    -> ``select(keys).distinct()`` (D3)
* aggregates only              -> global ``agg`` (A10, D5)
* ``group by cube(a, b)``, ``rollup(a, b)`` or ``grouping sets ((a, b), (a), ())`` with aggregates -> the lattice of
  :mod:`.lattice`, one pass over the rows, with ``grouping_id`` (A11)
* select items                 -> ``selectExpr`` (F2), later items may name earlier ones (F4)
* columns only                 -> ``withColumns``, all input columns stay (F3, W2)

Mixing select items with keys or aggregates would silently drop entries in the reference; here it is an
error naming them (D6).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import cube_sets, grouping_sets, measure_of, rollup_sets

KINDS = ("group", "agg", "select", "column")

_GROUP_RE = re.compile(r"^\s*group\s+by\s+(.*)$", re.IGNORECASE | re.DOTALL)
_AGG_RE = re.compile(r"\b(sum|avg|count|max|min)\s*\(", re.IGNORECASE)
_OVER_RE = re.compile(r"\bover\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Transformation:
    output_column: str
    expression: str
    kind: str | None = None
    # an ordered window to compute with hot keys split (see operators.windows); the expression text then
    # documents the same window in SQL
    skew_safe: dict | None = field(default=None, hash=False, compare=False)


def as_transformation(e: "Transformation | dict") -> "Transformation":
    if isinstance(e, Transformation):
        return e
    return Transformation(e.get("output_column", ""), e["expression"], e.get("kind"), e.get("skew_safe"))


def split_top_level(text: str, sep: str = ",") -> list[str]:
    """Split on ``sep`` outside parentheses, brackets and quotes; blanks are dropped."""
    parts, depth, quote, cur = [], 0, None, []
    for ch in text:
        if quote:
            cur.append(ch)
            if ch == quote:
                quote = None
            continue
        if ch in ("'", '"', "`"):
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == sep and depth == 0:
            parts.append("".join(cur).strip())
            cur = []
            continue
        cur.append(ch)
    parts.append("".join(cur).strip())
    return [p for p in parts if p]


def classify(t: Transformation) -> str:
    if t.kind:
        if t.kind not in KINDS:
            raise ValueError(f"unknown transformation kind {t.kind!r}")
        return t.kind
    if _GROUP_RE.match(t.expression):
        return "group"
    if _OVER_RE.search(t.expression):
        return "window"
    if _AGG_RE.search(t.expression):
        return "agg"
    return "select"


_SETS_RE = re.compile(r"^\s*(cube|rollup|grouping\s+sets)\s*\((.*)\)\s*$", re.IGNORECASE | re.DOTALL)


def grouping_sets_of(keys: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """Keys and sets of a single ``cube(..)``, ``rollup(..)`` or ``grouping sets (..)`` entry; None for plain keys."""
    m = _SETS_RE.match(keys[0]) if len(keys) == 1 else None
    if not m:
        if any(_SETS_RE.match(k) for k in keys):
            raise ValueError("a cube, rollup or grouping sets entry stands alone")
        return None
    items = split_top_level(m.group(2))
    kind = m.group(1).lower()
    if kind == "cube":
        return items, [list(s) for s in cube_sets(items)]
    if kind == "rollup":
        return items, [list(s) for s in rollup_sets(items)]
    sets = [split_top_level(i[1:-1]) if i.startswith("(") and i.endswith(")") else [i] for i in items]
    # "()" is the set without keys; split_top_level drops blanks only inside a part
    return list(dict.fromkeys(k for s in sets for k in s)), sets


def group_keys(expression: str) -> list[str]:
    m = _GROUP_RE.match(expression)
    return split_top_level(m.group(1) if m else expression)


def only_adds_columns(entries: list[Transformation | dict]) -> bool:
    """True when the entries route to added columns (F3), i.e. every input column stays."""
    ts = [as_transformation(e) for e in entries]
    roles = [classify(t) for t in ts]
    return bool(roles) and all(r in ("column", "window") for r in roles)


def apply_transformations(df: DataFrame, entries: list[Transformation | dict], having: str | None = None) -> DataFrame:
    """``having``: SQL text over the output of group keys and aggregates."""
    ts = [as_transformation(e) for e in entries]
    having = having.strip() if having else None
    if having and not any(classify(t) in ("group", "agg") for t in ts):
        raise ValueError("having needs group keys or aggregates")
    if not ts:
        return df
    roles = [(classify(t), t) for t in ts]
    has_select = any(r == "select" for r, _ in roles)
    # a window stands alone as an added column unless there are select items to sit beside
    roles = [("select" if has_select else "column", t) if r == "window" else (r, t) for r, t in roles]

    keys = [k for r, t in roles if r == "group" for k in group_keys(t.expression)]
    aggs = [t for r, t in roles if r == "agg"]
    selects = [t for r, t in roles if r == "select"]
    columns = [t for r, t in roles if r == "column"]

    if keys or aggs:
        dropped = [t.output_column or t.expression for t in selects + columns]
        if dropped:
            raise ValueError(f"cannot combine group keys/aggregates with select or column entries: {dropped}")
        lattice = grouping_sets_of(keys) if keys else None
        if lattice:
            unnamed = [t.expression for t in aggs if not t.output_column]
            if unnamed or not aggs:
                raise ValueError(f"grouping sets need aggregates with an output_column: {unnamed}")
            return grouping_sets(df, *lattice, [measure_of(t.output_column, t.expression) for t in aggs], having)
        agg_cols = [F.expr(t.expression).alias(t.output_column) if t.output_column else F.expr(t.expression)
                    for t in aggs]
        if keys and agg_cols:
            out = df.groupBy(*[F.expr(k) for k in keys]).agg(*agg_cols)
        elif keys:
            out = df.select(*[F.expr(k) for k in keys]).distinct()
        else:
            out = df.agg(*agg_cols)
        return out.filter(F.expr(having)) if having else out
    if selects and columns:
        raise ValueError(f"cannot combine select items with added columns: {[t.output_column for t in columns]}")
    if selects:
        return df.selectExpr(*[_as(t) for t in selects])
    unnamed = [t.expression for t in columns if not t.output_column]
    if unnamed:
        raise ValueError(f"added columns need an output_column: {unnamed}")
    # in the written order, so a later entry may read an earlier one; consecutive skew-safe windows
    # that share partitioning and ordering run as one window
    from .range_frames import from_spec as range_from_spec
    from .windows import from_spec
    batch: list[tuple[str, dict]] = []
    for t in columns:
        if t.skew_safe and t.skew_safe.get("func") == "range":
            if batch:
                df, batch = from_spec(df, batch), []
            df = range_from_spec(df, t.output_column, t.skew_safe)
            continue
        if t.skew_safe:
            batch.append((t.output_column, t.skew_safe))
            continue
        if batch:
            df, batch = from_spec(df, batch), []
        df = df.withColumn(t.output_column, F.expr(t.expression))
    return from_spec(df, batch) if batch else df


def _as(t: Transformation) -> str:
    if not t.output_column:
        return t.expression
    return f"{t.expression} AS `{t.output_column}`"
