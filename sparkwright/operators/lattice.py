"""Grouping sets, cube and rollup as a lattice of mergeable states (A11), and sketches that merge later.

Spark's own grouping sets expand every input row once per set before the aggregation: a cube over k keys makes 2^k
copies of the fact. Here the fact is aggregated once, at the finest grain, into states that merge (sums, counts, least
and greatest values, sketches). That table is written, measured, and every coarser set is derived from the smallest
finer set that holds its keys. Derived levels are merges of already small tables, and branches that share a level
share its shuffle.

A measure is ``Measure(output, func, value)``. Functions: ``count``, ``sum``, ``min``, ``max``, ``avg``, ``var_pop``
(of decimals, from exact sums), ``approx_distinct`` (HyperLogLog) and ``quantile`` (KLL). A distinct count is no
function of these; :mod:`.distincts` has the exact form that merges.

A key that is null in the data and a key that is aggregated away differ in ``grouping_id``, whose bits are those of
Spark's and SQL's function: the first key is the highest bit, 1 where the key is aggregated away.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_location


@dataclass(frozen=True)
class Measure:
    output: str
    func: str
    value: str | None = None      # SQL expression; None with count counts rows
    cast: str | None = None
    accuracy: int | None = None   # approx_distinct: log2 of the registers (14); quantile: the sketch's k (400)
    rank: float = 0.5             # quantile: which one

    def states(self) -> list[tuple[str, Column, Column]]:
        """(name, state over input rows, merge of states) of each state column."""
        v = F.expr(self.value) if self.value else None
        one = f"__{self.output}"
        n = F.count(v if v is not None else F.lit(1))
        if self.func == "count":
            return [(one, n, F.sum(one))]
        if v is None:
            raise ValueError(f"{self.func} needs a value")
        if self.func == "sum":
            return [(one, F.sum(v), F.sum(one))]
        if self.func in ("min", "max"):
            f = getattr(F, self.func)
            return [(one, f(v), f(one))]
        if self.func == "avg":
            return [(f"{one}_s", F.sum(v), F.sum(f"{one}_s")), (f"{one}_n", n, F.sum(f"{one}_n"))]
        if self.func == "var_pop":
            exact = v.cast("decimal(18,4)")
            return [(f"{one}_s", F.sum(exact), F.sum(f"{one}_s")), (f"{one}_q", F.sum(exact * exact), F.sum(f"{one}_q")),
                    (f"{one}_n", n, F.sum(f"{one}_n"))]
        if self.func == "approx_distinct":
            return [(one, F.hll_sketch_agg(v, self.accuracy or 14), F.hll_union_agg(one))]
        if self.func == "quantile":
            k = self.accuracy or 400
            return [(one, F.expr(f"kll_sketch_agg_double(CAST({self.value} AS DOUBLE), {k})"), F.expr(f"kll_merge_agg_double(`{one}`, {k})"))]
        raise ValueError(f"no mergeable aggregate {self.func!r}")

    def finish(self) -> Column:
        one = f"__{self.output}"
        if self.func == "avg":
            c = F.try_divide(F.col(f"{one}_s").cast("double"), F.col(f"{one}_n"))
        elif self.func == "var_pop":
            n = F.col(f"{one}_n").cast("double")
            mean = F.try_divide(F.col(f"{one}_s").cast("double"), n)
            c = F.when(n > 0, F.greatest(F.try_divide(F.col(f"{one}_q").cast("double"), n) - mean * mean, F.lit(0.0)))
        elif self.func == "approx_distinct":
            c = F.hll_sketch_estimate(one)
        elif self.func == "quantile":
            c = F.when(F.expr(f"kll_sketch_get_n_double(`{one}`)") > 0, F.expr(f"kll_sketch_get_quantile_double(`{one}`, {self.rank}D)"))
        else:
            c = F.col(one)
        return (c.cast(self.cast) if self.cast else c).alias(self.output)


FUNCS = ("count", "sum", "min", "max", "avg", "var_pop")
_CALL = re.compile(rf"^\s*({'|'.join(FUNCS)})\s*\((.*)\)\s*$", re.IGNORECASE | re.DOTALL)
_CAST = re.compile(r"^\s*cast\s*\((.*)\s+as\s+([a-z]+(?:\s*\([0-9, ]+\))?)\s*\)\s*$", re.IGNORECASE | re.DOTALL)


def _balanced(text: str) -> bool:
    depth = 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            return False
    return depth == 0


def measure_of(output: str, text: str) -> Measure:
    """The measure that an aggregate's SQL text denotes: one of the functions over an expression, perhaps in a CAST.

    Other text (an expression around several aggregates, a distinct aggregate) does not merge, and is an error rather
    than a silent recomputation for each set.
    """
    cast, inner = None, text
    m = _CAST.match(text)
    if m and _balanced(m.group(1)):
        inner, cast = m.group(1), m.group(2)
    m = _CALL.match(inner)
    if not m or not _balanced(m.group(2)) or re.match(r"\s*distinct\b", m.group(2), re.IGNORECASE):
        raise ValueError(f"not an aggregate that merges from level to level: {text!r}")
    func, value = m.group(1).lower(), m.group(2).strip()
    return Measure(output, func, None if func == "count" and value in ("*", "1") else value, cast)


_NAME = re.compile(r"^(?:`?\w+`?\.)*`?(\w+)`?$")
_NAMED = re.compile(r"^(.*\S)\s+as\s+`?(\w+)`?$", re.IGNORECASE | re.DOTALL)


def key_column(text: str) -> tuple[str, Column]:
    """Name and column of a key: a column, perhaps with its table's alias, or ``expression AS name``."""
    m = _NAME.match(text.strip())
    if m:
        return m.group(1), F.expr(text)
    m = _NAMED.match(text.strip())
    if not m or not _balanced(m.group(1)):
        raise ValueError(f"a key of a grouping set is a column or 'expression AS name': {text!r}")
    return m.group(2), F.expr(m.group(1))


def cube_sets(keys: list[str]) -> list[tuple[str, ...]]:
    return [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def rollup_sets(keys: list[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def finest(df: DataFrame, keys: list, measures: list[Measure]) -> DataFrame:
    """One row of states for each combination of the keys: the only pass over the rows."""
    states = [build.alias(name) for m in measures for name, build, _ in m.states()]
    return df.groupBy(*keys).agg(*states)


def coarser(level: DataFrame, keys: Iterable[str], measures: list[Measure]) -> DataFrame:
    """States of a set with fewer keys, merged from those of a finer one."""
    return level.groupBy(*keys).agg(*[merge.alias(name) for m in measures for name, _, merge in m.states()])


def parents(sets: list[tuple[str, ...]], keys: list[str], distinct: dict[str, int], rows: int) -> dict[tuple[str, ...], tuple[str, ...]]:
    """For every set but the finest, the set it is derived from: the smallest that holds its keys, by the product of
    the keys' distinct values (at most the finest table's rows)."""

    def size(s):
        n = 1
        for k in s:
            n *= max(1, distinct.get(k, 1)) + 1
        return min(n, rows)

    full = tuple(keys)
    have = {full, *sets}
    return {s: min((p for p in have if set(s) < set(p)), key=lambda p: (size(p), len(p), p)) for s in sets if s != full}


def grouping_sets(df: DataFrame, keys: list[str], sets: list[Iterable[str]], measures: list[Measure],
                  having: str | None = None) -> DataFrame:
    """The rows of all ``sets`` with the keys, ``grouping_id`` and the measures; ``having`` is SQL text over these.

    The finest level is written under the shared folder, so its states survive lost executors and the levels above
    are merged from there; the driver sees one row, the number of its rows and the keys' distinct values.
    """
    keys = list(dict.fromkeys(keys))
    columns = {k: key_column(k) for k in keys}
    names = [columns[k][0] for k in keys]
    if len(set(names)) < len(names):
        raise ValueError(f"keys of the same name: {names}")
    places = {k: i for i, k in enumerate(keys)}
    wanted = []
    for s in sets:
        unknown = set(s) - set(keys)
        if unknown:
            raise ValueError(f"grouping set over columns that are no keys: {sorted(unknown)}")
        # a set given twice gives its rows twice, as in SQL
        wanted.append(tuple(columns[k][0] for k in sorted(set(s), key=places.__getitem__)))
    spark = df.sparkSession
    base = finest(df, [columns[k][1].alias(columns[k][0]) for k in keys], measures)
    keys = names
    where = fresh_location(spark, "lattice")
    base.write.parquet(where)
    base = spark.read.schema(base.schema).parquet(where)
    seen = base.agg(F.count(F.lit(1)).alias("__rows"), *[F.approx_count_distinct(F.col(k)).alias(f"__d{i}") for i, k in enumerate(keys)]).first()
    derived = parents(list(dict.fromkeys(wanted)), keys, {k: seen[f"__d{i}"] for i, k in enumerate(keys)}, seen["__rows"])

    levels = {tuple(keys): base}
    for s in sorted(derived, key=len, reverse=True):
        levels[s] = coarser(levels[derived[s]], s, measures)
    types = {f.name: f.dataType for f in base.schema}
    out = None
    for s in wanted:
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        rows = levels[s].select(*[F.col(k) if k in s else F.lit(None).cast(types[k]).alias(k) for k in keys],
                                F.lit(gid).cast("bigint").alias("grouping_id"), *[m.finish() for m in measures])
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.expr(having)) if having and having.strip() else out


def cube(df: DataFrame, keys: list[str], measures: list[Measure], having: str | None = None) -> DataFrame:
    return grouping_sets(df, keys, cube_sets(keys), measures, having)


def rollup(df: DataFrame, keys: list[str], measures: list[Measure], having: str | None = None) -> DataFrame:
    return grouping_sets(df, keys, rollup_sets(keys), measures, having)
