"""Joins without an equality, as equi-joins on parts of the space.

``grid_join``: inequalities between columns of both sides. Each side is cut into tiles: quantile bands of its first
column, and within a band quantile bands of its second, so tiles hold about equal numbers of rows even where the columns
depend on each other. The true bounds of the tiles tell which pairs of tiles (cells of the join matrix) can match at all;
only those cells exist, and a row is sent to the cells of its tile. Tiles above ``target_rows``, such as rows of one
value, are dealt further by a hash of the whole row, so a cell gets about that many rows of each side whatever the
columns hold.

``overlap_join``: two spans that share a point. A span belongs to the level whose bucket width exceeds its length, so it
touches two buckets there at most; longer spans live on coarser levels, and are met there by copies of the shorter ones.
Every pair meets in one bucket alone, the first that both touch on the coarser span's level: no distinct is needed, and a
span of any length has a few copies. Buckets above ``target_rows`` left or ``RUN_ROWS`` right rows are dealt to cells by a
hash of the whole row, as in the grid. The pairs grow with the square of the input, so the number of tasks grows with them,
and a cell's rows are in the order of their spans, which keeps the files of the pairs small.

Both are inner joins and keep every alias of their inputs. Rows with a null in a compared column match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("<", "<=", ">", ">=")


def _literal_points(df: DataFrame, rows: list, schema) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _tiles(df: DataFrame, first: str, second: str | None, bands: int, side: str) -> DataFrame:
    """``df`` without rows that match nothing, with ``__{side}t``, the tile of each row; split points are fixed once."""
    x, y = f"__{side}x", f"__{side}y"
    df = df.withColumn(x, F.expr(first)).withColumn(y, F.expr(second) if second else F.lit(0))
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    probs = [i / bands for i in range(1, bands)] or [0.5]
    points = df.agg(F.percentile_approx(x, probs, 10000).alias("p")).first()["p"]
    band = F.lit(0)
    for p in sorted(set(points or [])):
        band = band + (F.col(x) > F.lit(p)).cast("int")
    df = df.withColumn(f"__{side}b", band)
    if not second:
        return df.withColumn(f"__{side}t", F.col(f"__{side}b"))
    inner = df.groupBy(F.col(f"__{side}b").alias(f"__{side}of")).agg(F.percentile_approx(y, probs, 10000).alias(f"__{side}p"))
    inner = _literal_points(df, inner.collect(), inner.schema)  # one row a band
    df = df.join(inner, F.col(f"__{side}b") == F.col(f"__{side}of"), "left")
    at = F.size(F.filter(F.coalesce(F.array_distinct(f"__{side}p"), F.array()), lambda s: F.col(y) > s))
    return df.withColumn(f"__{side}t", F.col(f"__{side}b") * bands + at).drop(f"__{side}of", f"__{side}p")


def _bounds(df: DataFrame, side: str) -> list:
    """One row a tile: its rows and the least and greatest value of both columns (at most bands * bands rows)."""
    x, y = f"__{side}x", f"__{side}y"
    return df.groupBy(f"__{side}t").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).collect()


def _can(op: str, *ends) -> bool:
    """Whether some value between the left bounds (the first two) stands in ``op`` to some value between the right ones."""
    low_l, high_l, low_r, high_r = ((v != v, 0 if v != v else v) for v in ends)  # not-a-number is above all others
    return {"<": low_l < high_r, "<=": low_l <= high_r, ">": high_l > low_r, ">=": high_l >= low_r}[op]


def grid_join(left: DataFrame, right: DataFrame, bounds: list[tuple[str, str, str]], cond: str | Column | None = None,
              bands: int = 8, target_rows: int = 100_000) -> DataFrame:
    """Rows of ``left`` and ``right`` for which all ``bounds`` (left expression, operator, right expression) hold, and
    ``cond``, if given. The first two inequalities make the grid; the driver sees their tiles' bounds, at most
    ``bands * bands`` rows a side, and the cells, at most the square of that."""
    if not bounds:
        raise ValueError("a grid join needs at least one inequality")
    for _, op, _ in bounds:
        if op not in OPS:
            raise ValueError(f"a grid join takes {OPS}, not {op!r}")
    grid, spark = bounds[:2], left.sparkSession
    two = len(grid) == 2
    lrows = _tiles(left, grid[0][0], grid[1][0] if two else None, bands, "l")
    rrows = _tiles(right, grid[0][2], grid[1][2] if two else None, bands, "r")
    lt, rt = _bounds(lrows, "l"), _bounds(rrows, "r")
    parts = lambda n: max(1, math.ceil(n / target_rows))
    cells = [(a["__lt"], b["__rt"], parts(a["n"]), parts(b["n"])) for a in lt for b in rt
             if _can(grid[0][1], a["x0"], a["x1"], b["x0"], b["x1"]) and (not two or _can(grid[1][1], a["y0"], a["y1"], b["y0"], b["y1"]))]

    def sent(rows: DataFrame, side: str) -> DataFrame:
        """Rows with the cells they are sent to: (tile, other tile, own part, each part of the other)."""
        own, other = (0, 1) if side == "l" else (1, 0)
        by_tile: dict[int, list[tuple[int, int, int]]] = {}
        for c in cells:
            by_tile.setdefault(c[own], []).append((c[other], c[2 + own], c[2 + other]))
        table = spark.createDataFrame(list(by_tile.items()), f"__{side}k int, __{side}cells array<struct<tile: int, own: int, other: int>>")
        # a hash of the whole row, so that a task that runs again deals as before
        rows = rows.withColumn(f"__{side}h", _hashed(rows, "xy")).join(F.broadcast(table), F.col(f"__{side}t") == F.col(f"__{side}k"))
        rows = rows.withColumn(f"__{side}c", F.explode(f"__{side}cells"))
        rows = rows.withColumn(f"__{side}i", F.pmod(f"__{side}h", f"__{side}c.own").cast("int"))
        rows = rows.withColumn(f"__{side}j", F.explode(F.sequence(F.lit(0), F.col(f"__{side}c.other") - 1)))
        a, b = (f"__{side}t", f"__{side}c.tile") if side == "l" else (f"__{side}c.tile", f"__{side}t")
        i, j = (f"__{side}i", f"__{side}j") if side == "l" else (f"__{side}j", f"__{side}i")
        rows = rows.withColumn(f"__{side}cell", F.struct(F.col(a).alias("l"), F.col(b).alias("r"), F.col(i).alias("i"), F.col(j).alias("j")))
        return rows.drop(*[f"__{side}{c}" for c in ("x", "y", "b", "t", "h", "k", "cells", "c", "i", "j")])

    on = F.col("__lcell") == F.col("__rcell")
    for a, op, b in bounds:
        on = on & F.expr(f"({a}) {op} ({b})")
    if cond is not None and not (isinstance(cond, str) and not cond.strip()):
        on = on & (F.expr(cond) if isinstance(cond, str) else cond)
    return sent(lrows, "l").join(sent(rrows, "r"), on).drop("__lcell", "__rcell")


#: Bucket widths of neighbouring levels: a span's bucket is at most this many times as wide as the span.
RATIO = 4
#: Right rows of a cell. The pairs of a left row are a run of these, which the next left rows repeat as long as their spans
#: match the same: so short a run is repeated often within a page of a Parquet file.
RUN_ROWS = 512
#: Pairs that a task compares, about. So few that a Parquet writer's dictionary holds the keys of the pairs it writes.
TASK_PAIRS = 20_000_000


def _hashed(rows: DataFrame, ends: str) -> Column:
    """A hash of the whole row, or, where a column can't be hashed, of its helper columns that end so."""
    plain = not any(k in f.dataType.simpleString() for f in rows.schema for k in ("map<", "variant"))
    return F.expr("xxhash64(*)") if plain else F.xxhash64(*[c for c in rows.columns if c.startswith("__") and c[-1] in ends])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[tuple[str, str]] | None = None,
                 cond: str | Column | None = None, width: float | None = None, target_rows: int = 10_000) -> DataFrame:
    """Pairs whose closed spans (low, high; numbers or SQL text that gives numbers) share a point, with equal ``keys``.

    ``width`` is the finest level's bucket width; without it, about the median length of the shorter side's spans is
    taken from one aggregate of bounded memory. A span whose end lies before its start matches nothing. With ``keys``,
    buckets aren't dealt: the keys do that.
    """
    def spans(df, span, side):
        low, high = F.expr(span[0]).cast("double"), F.expr(span[1]).cast("double")
        return df.withColumn(f"__{side}0", low).withColumn(f"__{side}1", high).where(F.col(f"__{side}0") <= F.col(f"__{side}1"))

    lrows, rrows = spans(left, left_span, "l"), spans(right, right_span, "r")
    if width is None:
        found = [d.agg(F.percentile_approx(F.col(f"__{s}1") - F.col(f"__{s}0"), 0.5, 1000)).first()[0] for d, s in ((lrows, "l"), (rrows, "r"))]
        width = min([w for w in found if w and w > 0], default=1.0)
    if width <= 0:
        raise ValueError("the bucket width must be above 0")

    def own_level(side):
        # the finest level whose buckets are wider than the span
        length = F.col(f"__{side}1") - F.col(f"__{side}0")
        return F.when(length < width, F.lit(0)).otherwise(F.floor(F.log(length / width) / math.log(RATIO)) + 1).cast("int")

    lrows, rrows = lrows.withColumn("__llev", own_level("l")), rrows.withColumn("__rlev", own_level("r"))
    # levels in use, some twenty at most: lengths of doubles span few powers of the ratio
    levels = {s: sorted(r[0] for r in d.select(f"__{s}lev").distinct().collect()) for s, d in (("l", lrows), ("r", rrows))}

    def sent(rows, side, other):
        lev = F.col(f"__{side}lev")

        def at(level):
            scale = F.lit(float(width)) * F.pow(F.lit(float(RATIO)), level)
            return F.floor(F.col(f"__{side}0") / scale).cast("bigint"), F.floor(F.col(f"__{side}1") / scale).cast("bigint")

        def copies(level, kind, when):
            first, last = at(level)
            # of the pair that meets in a bucket, the span that starts there or before: told by the first bucket
            one = F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), b.alias("bucket"), first.alias("first")))
            return F.when(when, one).otherwise(F.array().cast("array<struct<kind: string, level: int, bucket: bigint, first: bigint>>"))

        # own level against own level, own against finer ones of the other side, and as a finer one of the other's
        kinds = [copies(lev, "same", F.lit(True)), copies(lev, f"{side} coarse", lev > (levels[other][0] if levels[other] else 0))]
        kinds += [copies(F.lit(x), f"{other} coarse", lev < x) for x in levels[other]]
        rows = rows.withColumn(f"__{side}m", F.explode(F.concat(*kinds)))
        return rows.withColumn(f"__{side}meet", F.struct(*[F.col(f"__{side}m.{c}") for c in ("kind", "level", "bucket")]))

    lrows, rrows = sent(lrows, "l", "r"), sent(rrows, "r", "l")
    on = F.col("__lmeet.bucket") == F.greatest("__lm.first", "__rm.first")
    on = on & (F.col("__l0") <= F.col("__r1")) & (F.col("__r0") <= F.col("__l1"))
    for a, b in keys or []:
        on = on & (F.expr(a) == F.expr(b))
    if cond is not None and not (isinstance(cond, str) and not cond.strip()):
        on = on & (F.expr(cond) if isinstance(cond, str) else cond)
    mine = [f"__{s}{c}" for s in "lr" for c in ("0", "1", "lev", "m", "meet")]
    if keys:
        return lrows.join(rrows, (F.col("__lmeet") == F.col("__rmeet")) & on).drop(*mine)

    # buckets that both sides have, one of them with more rows than a cell takes: at most one for so many rows
    sizes = lrows.select(F.col("__lmeet").alias("__meet"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        rrows.select(F.col("__rmeet").alias("__meet"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    sizes = sizes.groupBy("__meet").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    most = {"l": target_rows, "r": min(target_rows, RUN_ROWS)}
    large = sizes.where((F.least("l", "r") > 0) & ((F.col("l") > most["l"]) | (F.col("r") > most["r"])))
    large = large.select("__meet", *[F.ceil(F.col(s) / most[s]).cast("int").alias(f"__parts_{s}") for s in "lr"])

    # by the pairs that the tasks make: AQE would merge them by the rows that they read
    tasks = math.ceil((sizes.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0) / TASK_PAIRS)

    def dealt(rows, side, other):
        """Rows with their cell, own part by a hash of the row and each part of the other side, in the order of their spans.

        The join keeps this order, so that neighbours, which match the same rows, follow one another in what it makes; a
        sort alone would be taken out of a join's input, so it is the window's."""
        rows = rows.withColumn(f"__{side}h", _hashed(rows.drop(f"__{side}m", f"__{side}meet"), "01"))
        rows = rows.join(F.broadcast(large), F.col(f"__{side}meet") == F.col("__meet"), "left")
        own = F.pmod(f"__{side}h", F.coalesce(f"__parts_{side}", F.lit(1))).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(f"__parts_{other}", F.lit(1)) - 1))
        rows = rows.withColumns({f"__{side}own": own, f"__{side}each": each})
        i, j = (f"__{side}own", f"__{side}each") if side == "l" else (f"__{side}each", f"__{side}own")
        rows = rows.withColumn(f"__{side}cell", F.struct(f"__{side}meet", F.col(i).alias("i"), F.col(j).alias("j")))
        rows = rows.drop(f"__{side}own", f"__{side}each", f"__{side}h", "__meet", "__parts_l", "__parts_r")
        if tasks > 1:
            rows = rows.repartition(tasks, f"__{side}cell")
        place = F.row_number().over(Window.partitionBy(f"__{side}cell").orderBy(f"__{side}0", f"__{side}1"))
        return rows.withColumn(f"__{side}place", place).where(F.col(f"__{side}place") > 0)

    on = on & (F.col("__lcell") == F.col("__rcell"))
    mine += ["__lcell", "__lplace", "__rcell", "__rplace"]
    # by a shuffle, which deals the cells, not by broadcasting a side
    return dealt(lrows, "l", "r").join(dealt(rrows, "r", "l").hint("merge"), on).drop(*mine)
