"""Join operators (J1-J13) and the column bookkeeping a chain of aliased joins needs.

All join conditions are SQL text through ``F.expr``, never a USING column name. The physical strategy
(broadcast hash, shuffled hash, sort-merge) is Catalyst's and AQE's, except where a remedy chooses it:

* ``Chain``: the left-deep chain of a job spec, with (alias, column) origins, flattening, self joins, and
  the salted, band and outer-salted steps.
* ``join``: one step. A join without a condition runs only against a measured small side.
* band form (J8): a ``BETWEEN`` condition as an equi-join on value buckets.
* ``measure`` / ``fits_broadcast`` / ``broadcast_join`` (J12): broadcast only behind a measured bound.
* salting (J13): ``salted_join`` for keys hot on the left, ``add_salt_columns_right_skew`` for keys hot on
  the right, and ``salted_outer_join`` for right and full joins by exact decomposition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Join type spellings accepted in a spec, mapped to Spark's names.
JOIN_TYPES = {
    "inner": "inner", "join": "inner",
    "left": "left", "left_outer": "left", "leftouter": "left", "left outer": "left",
    "right": "right", "right_outer": "right", "rightouter": "right", "right outer": "right",
    "full": "full", "outer": "full", "full_outer": "full", "fullouter": "full", "full outer": "full",
    "left_semi": "left_semi", "semi": "left_semi", "leftsemi": "left_semi",
    "left_anti": "left_anti", "anti": "left_anti", "leftanti": "left_anti",
    "cross": "cross",
}


def spark_join_type(text: str) -> str:
    key = (text or "inner").strip().lower()
    if key not in JOIN_TYPES:
        raise ValueError(f"unknown join type {text!r}")
    return JOIN_TYPES[key]


def condition(text: str | Column | None) -> Column | None:
    if text is None or isinstance(text, Column):
        return text
    if not text.strip():
        return None
    return F.expr(text)


@dataclass
class Chain:
    """A DataFrame together with the (alias, column) origin of each of its columns, in order."""

    df: DataFrame
    cols: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, alias: str) -> "Chain":
        return cls(df, [(alias, c) for c in df.columns])

    @property
    def aliases(self) -> list[str]:
        seen: list[str] = []
        for a, _ in self.cols:
            if a not in seen:
                seen.append(a)
        return seen

    def has_duplicates(self) -> bool:
        names = [c for _, c in self.cols]
        return len(names) != len(set(names))

    def flattened(self) -> "Chain":
        """One column per (alias, column); a later duplicate name becomes ``alias_column``."""
        if not self.has_duplicates():
            return self
        seen: set[str] = set()
        exprs = []
        out_cols = []
        for a, c in self.cols:
            name = c if c not in seen else f"{a}_{c}"
            while name in seen:
                name = f"{a}_{name}"
            seen.add(name)
            ref = F.col(f"`{a}`.`{c}`") if a else F.col(f"`{c}`")
            exprs.append(ref.alias(name))
            out_cols.append(name)
        df = self.df.select(*exprs)
        # after flattening the names are unique, so the frame keeps no alias of its own
        return Chain(df, [("", c) for c in out_cols])

    def join(self, right: DataFrame, right_alias: str, cond: str | Column | None, how: str) -> "Chain":
        how = spark_join_type(how)
        if right_alias in self.aliases:
            raise ValueError(f"alias {right_alias!r} is already in the join chain")
        df = join(self.df, right, cond, how)
        if how in ("left_semi", "left_anti"):
            return Chain(df, list(self.cols))
        return Chain(df, self.cols + [(right_alias, x) for x in right.columns])

    def join_salted(self, right: DataFrame, right_alias: str, cond: str | Column | None, how: str,
                    left_keys: list[str], right_keys: list[str], salts: int = 8,
                    salt_from: list[str] | None = None, hot_fraction: float | None = None,
                    skewed_side: str = "left") -> "Chain":
        """An equi-join step with salted keys (J13); ``cond`` may add further (non-equi) terms.

        ``skewed_side="right"`` handles keys that are hot on the right table (for example the many side of
        ``orders LEFT JOIN lineitem``), which AQE cannot split for a left outer join.
        """
        how = spark_join_type(how)
        if how not in SALTABLE:
            raise ValueError(f"salted join is only exact for {SALTABLE}, not {how!r}")
        if right_alias in self.aliases:
            raise ValueError(f"alias {right_alias!r} is already in the join chain")
        extra = condition(cond)
        if skewed_side == "right":
            r = right.alias(right_alias)
            rkeys = [k if "." in k else f"{right_alias}.{k}" for k in right_keys]
            if how in ("left_semi", "left_anti"):
                # only key existence matters: distinct keys (partial aggregation) remove the hot rows
                if extra is not None:
                    raise ValueError("a right-skewed semi/anti join takes key equality only")
                keys = r.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(rkeys)]).distinct()
                on = _and([F.col(lk) == F.col(f"__k{i}") for i, lk in enumerate(left_keys)])
                return Chain(self.df.join(keys, on, how), list(self.cols))
            sf = salt_from or [f"`{right_alias}`.`{c}`" for c in right.columns]
            if how == "left" and extra is not None:
                return self._left_join_right_skew_with_condition(right, right_alias, r, left_keys, rkeys, extra,
                                                                 salts, sf, hot_fraction)
            left_s, right_s = add_salt_columns_right_skew(self.df, r, left_keys, rkeys, salts, sf,
                                                          hot_fraction if hot_fraction is not None else 0.001)
            terms = [F.col(lk) == F.col(rk) for lk, rk in zip(left_keys, rkeys)]
            terms.append(F.col("__lsalt") == F.col("__rsalt"))
            if extra is not None:
                terms.append(extra)
            df = left_s.join(right_s, _and(terms), how)
            # a hot key always has right rows somewhere, so its unmatched replicas are dropped
            df = df.filter(~(F.col("__lhot") & F.col("__rmark").isNull())) \
                   .drop("__lsalt", "__rsalt", "__lhot", "__rmark")
            return Chain(df, self.cols + [(right_alias, x) for x in right.columns])
        if salt_from is None:
            salt_from = [f"`{a}`.`{c}`" if a else f"`{c}`" for a, c in self.cols]
        left_s, right_s = add_salt_columns(self.df, right, left_keys, right_keys, salts, salt_from, hot_fraction)
        terms = [F.col(lk) == F.col(rk) for lk, rk in zip(left_keys, right_keys)]
        terms.append(F.col("__lsalt") == F.col("__rsalt"))
        if extra is not None:
            terms.append(extra)
        df = left_s.join(right_s.alias(right_alias), _and(terms), how).drop("__lsalt", "__rsalt")
        if how in ("left_semi", "left_anti"):
            return Chain(df, list(self.cols))
        return Chain(df, self.cols + [(right_alias, x) for x in right.columns])

    def _left_join_right_skew_with_condition(self, right: DataFrame, right_alias: str, r: DataFrame,
                                             left_keys: list[str], rkeys: list[str], extra: Column, salts: int,
                                             salt_from: list[str], hot_fraction: float | None) -> "Chain":
        """``LEFT JOIN ... ON keys AND extra`` with keys hot on the right, exactly.

        A hot key's left row may meet no right row under ``extra``, so unmatched replicas cannot simply be
        dropped. The result is put together from three parts instead:

        1. the matched pairs: the salted inner join;
        2. left rows of cold keys without a partner: an anti join (cold keys have no hot partners);
        3. left rows of hot keys without a partner: those rows ``EXCEPT ALL`` the left side of their
           matches. Identical rows are matched or unmatched together, so the multiplicities come out
           right.

        The union drops alias qualifiers, so the chain is flattened afterwards (as after a self join).
        """
        left_s, right_s = add_salt_columns_right_skew(self.df, r, left_keys, rkeys, salts, salt_from,
                                                      hot_fraction if hot_fraction is not None else 0.001)
        on = _and([F.col(lk) == F.col(rk) for lk, rk in zip(left_keys, rkeys)]
                  + [F.col("__lsalt") == F.col("__rsalt"), extra])
        lref = [F.col(f"`{a}`.`{c}`") if a else F.col(f"`{c}`") for a, c in self.cols]
        rref = [F.col(f"`{right_alias}`.`{c}`") for c in right.columns]
        nulls = [F.lit(None).cast(f.dataType) for f in right.schema.fields]
        matched = left_s.join(right_s, on, "inner")
        cold_unmatched = left_s.filter(~F.col("__lhot")).join(right_s, on, "left_anti")
        hot_rows = left_s.filter(F.col("__lhot") & (F.col("__lsalt") == 0)).select(*lref)
        hot_matched = matched.filter(F.col("__lhot")).select(*lref)
        hot_unmatched = hot_rows.exceptAll(hot_matched)
        flat = self.flattened()
        lnames = [c for _, c in flat.cols]
        taken = set(lnames)
        rnames = []
        for c in right.columns:
            name = c if c not in taken else f"{right_alias}_{c}"
            while name in taken:
                name = f"{right_alias}_{name}"
            taken.add(name)
            rnames.append(name)
        names = lnames + rnames
        parts = [matched.select(*lref, *rref),
                 cold_unmatched.select(*lref, *nulls),
                 hot_unmatched.select(*[F.col(c) for c in hot_unmatched.columns], *nulls)]
        parts = [p.toDF(*names) for p in parts]
        df = parts[0].unionAll(parts[1]).unionAll(parts[2])
        return Chain(df, [("", c) for c in names])

    def join_salted_outer(self, right: DataFrame, right_alias: str, how: str, left_keys: list[str],
                          right_keys: list[str], salts: int = 8, salt_from: list[str] | None = None,
                          hot_fraction: float | None = None, skewed_side: str = "left") -> "Chain":
        """A right or full outer join step with salted keys, by :func:`salted_outer_join`.

        The union inside that decomposition drops alias qualifiers, so, as after a self join (D12), the
        result is flattened: later text uses bare names, and a right-side name already taken becomes
        ``alias_name``.
        """
        if right_alias in self.aliases:
            raise ValueError(f"alias {right_alias!r} is already in the join chain")
        base = self.flattened()
        # left names may be written alias.column: map them to the flattened names
        mapping = dict(zip([f"{a}.{c}" if a else c for a, c in self.cols], [c for _, c in base.cols]))
        unq = lambda k: k.split(".", 1)[1] if k.startswith(f"{right_alias}.") else k
        taken = {c for _, c in base.cols}
        rnames = []
        for c in right.columns:
            name = c if c not in taken else f"{right_alias}_{c}"
            while name in taken:
                name = f"{right_alias}_{name}"
            taken.add(name)
            rnames.append(name)
        r = right.toDF(*rnames)
        lkeys = [mapping.get(k, k) for k in left_keys]
        rkeys = [rnames[right.columns.index(unq(k))] for k in right_keys]
        if salt_from and skewed_side == "right":
            sf = [rnames[right.columns.index(unq(c))] for c in salt_from]
        elif salt_from:
            sf = [mapping.get(c, c) for c in salt_from]
        else:
            sf = None
        df = salted_outer_join(base.df, r, lkeys, rkeys, how, salts, sf, hot_fraction, skewed_side)
        return Chain(df, [("", c) for c in df.columns])

    def join_band(self, right: DataFrame, right_alias: str, cond: str | Column, low: str, high: str,
                  point: str, width: float | str, range_side: str = "left") -> "Chain":
        """An inner join whose condition holds ``low <= point <= high`` (J8, band form); see :func:`band_keys`."""
        if right_alias in self.aliases:
            raise ValueError(f"alias {right_alias!r} is already in the join chain")
        r = right.alias(right_alias)
        if width == "auto":
            width = auto_band_width(self.df if range_side == "left" else r, low, high)
        if range_side == "left":
            left_b = self.df.withColumn("__lband", F.explode(band_keys(low, high, width)))
            right_b = r.withColumn("__rband", point_key(point, width))
        else:
            left_b = self.df.withColumn("__lband", point_key(point, width))
            right_b = r.withColumn("__rband", F.explode(band_keys(low, high, width)))
        on = (F.col("__lband") == F.col("__rband")) & condition(cond)
        df = left_b.join(right_b, on, "inner").drop("__lband", "__rband")
        return Chain(df, self.cols + [(right_alias, x) for x in right.columns])

    def join_theta(self, right: DataFrame, right_alias: str, cond: str | Column | None, theta: dict) -> "Chain":
        """An inner join by inequalities (``bounds``) or by overlapping spans (``left``, ``right``); see :mod:`.theta`."""
        from .theta import grid_join, overlap_join
        if right_alias in self.aliases:
            raise ValueError(f"alias {right_alias!r} is already in the join chain")
        r = right.alias(right_alias)
        if theta.get("bounds"):
            df = grid_join(self.df, r, [tuple(b) for b in theta["bounds"]], cond, int(theta.get("bands", 8)), int(theta.get("target_rows", 100_000)))
        else:
            df = overlap_join(self.df, r, tuple(theta["left"]), tuple(theta["right"]), [tuple(k) for k in theta.get("keys", [])], cond, theta.get("width"))
        return Chain(df, self.cols + [(right_alias, x) for x in right.columns])

    def self_join(self, left_alias: str, right_alias: str, cond: str | Column) -> "Chain":
        """The current result with itself under two new aliases, inner.

        The chain is flattened first (D12): after re-aliasing, the old qualifiers are gone, so later text
        uses the two new aliases with the flattened names.
        """
        base = self.flattened()
        df = base.df.alias(left_alias).join(base.df.alias(right_alias), condition(cond), "inner")
        names = [c for _, c in base.cols]
        return Chain(df, [(left_alias, c) for c in names] + [(right_alias, c) for c in names])


# A cross product is only run with a right side of at most this many rows (and 256 MB), as measured; the
# right side is then broadcast and the left side streams past it, so the cost is linear in the left side.
CROSS_MAX_ROWS = 100_000


def join(left: DataFrame, right: DataFrame, cond: str | Column | None, how: str = "inner") -> DataFrame:
    """One join step with a SQL-text condition.

    A join without any condition (``cross``, or an inner join with blank text) pairs every row with every
    row. It is allowed only when the right side is proven small, and then broadcast; anything larger is an
    error rather than an all-pairs shuffle.
    """
    how = spark_join_type(how)
    c = condition(cond)
    if c is None and how in ("cross", "inner"):
        if not fits_broadcast(right, CROSS_MAX_ROWS):
            raise ValueError(f"cross join refused: the right side is not proven small "
                             f"(at most {CROSS_MAX_ROWS} rows and 256 MB)")
        return left.crossJoin(F.broadcast(right))
    if how == "cross":
        how = "inner"
    return left.join(right, c, how)


# ---------------------------------------------------------------------------------------------------------
# J8, band form: a range condition as an equi-join on value buckets
# ---------------------------------------------------------------------------------------------------------

def auto_band_width(ranges: DataFrame, low: str, high: str) -> float:
    """A bucket width about the median range length (one ``percentile_approx`` aggregate, bounded memory),
    so a typical range row falls into one or two buckets. Falls back to 1 for empty or point ranges."""
    w = ranges.agg(F.percentile_approx((F.expr(high) - F.expr(low)).cast("double"), 0.5, 1000)).first()[0]
    return float(w) if w and w > 0 else 1.0


def point_key(point: str, width: float) -> Column:
    return F.floor(F.expr(point) / F.lit(width)).cast("bigint")


def band_keys(low: str, high: str, width: float) -> Column:
    """Every bucket of ``width`` that ``[low, high]`` touches. A row of the range side is replicated once per
    bucket, a row of the point side falls in exactly one, so each matching pair meets exactly once and the
    shuffle is by bucket instead of a nested loop over all pairs. Exact for inner joins; empty or null
    ranges yield no bucket (and no match)."""
    lo, hi = point_key(low, width), point_key(high, width)
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def band_join(left: DataFrame, right: DataFrame, cond: str, low: str, high: str, point: str, width: float,
              range_side: str = "left") -> DataFrame:
    left_alias = "__bl"
    return Chain.of(left.alias(left_alias), left_alias).join_band(
        right, "__br", cond, low, high, point, width, range_side).df


# ---------------------------------------------------------------------------------------------------------
# Broadcast join behind a size check
# ---------------------------------------------------------------------------------------------------------

_FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "byte": 1, "smallint": 2, "short": 2, "int": 4, "integer": 4,
                "date": 4, "float": 4, "bigint": 8, "long": 8, "double": 8, "timestamp": 8,
                "timestamp_ntz": 8}


def _value_bytes(name: str, type_name: str) -> Column:
    """Bytes of one value: fixed widths by type, measured lengths for strings and binary, a per-element
    estimate for nested values."""
    c = F.col(f"`{name}`")
    if type_name in _FIXED_WIDTH:
        return F.lit(_FIXED_WIDTH[type_name])
    if type_name.startswith("decimal"):
        return F.lit(16)
    if type_name in ("string", "binary") or type_name.startswith(("varchar", "char")):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if type_name.startswith(("array", "map")):
        return F.coalesce(F.size(c), F.lit(0)) * F.lit(16)
    return F.lit(64)


def measure(df: DataFrame) -> tuple[int, int]:
    """Exact row count and an in-memory byte size of ``df`` in one two-phase aggregate.

    Every task sends one partial row, and no rows are funnelled into a single task. For a plain Parquet
    scan the count is answered from file metadata.
    """
    widths = [_value_bytes(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    row = F.lit(8)
    for w in widths:
        row = row + w
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("bigint")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count of ``df`` if it is at most ``max_rows``, else None."""
    n = df.count()
    return n if n <= max_rows else None


def fits_broadcast(df: DataFrame, max_rows: int = 2_000_000, max_bytes: int = 256 << 20) -> bool:
    """True when ``df`` is measured to hold at most ``max_rows`` rows and ``max_bytes`` bytes."""
    n, b = measure(df)
    return n <= max_rows and b <= max_bytes


def broadcast_join(left: DataFrame, right: DataFrame, cond: str | Column | None, how: str = "inner",
                   max_rows: int = 2_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Broadcast the right side, but only when its size is proven below the bounds.

    Beyond the bounds, the plain join is returned and Spark shuffles both sides (sort-merge, with AQE's
    skew splitting). For a right or full outer join the right side cannot be the build side, so no hint.
    """
    how = spark_join_type(how)
    if how in ("inner", "left", "left_semi", "left_anti", "cross") and fits_broadcast(right, max_rows, max_bytes):
        right = F.broadcast(right)
    return join(left, right, cond, how)


# ---------------------------------------------------------------------------------------------------------
# Salted equi-join
# ---------------------------------------------------------------------------------------------------------

SALTABLE = ("inner", "left", "left_semi", "left_anti")


def _shuffled(df: DataFrame) -> DataFrame:
    """A salted side, never to be broadcast: Spark's size estimate knows nothing of the replicas that ``explode`` makes, so
    a side that looks small would pass the driver ``salts`` times over."""
    return df.hint("merge")


def add_salt_columns(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                     salts: int = 8, salt_from: list[str] | None = None,
                     hot_fraction: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``__lsalt`` to the left and ``__rsalt`` (exploded) to the right; see :func:`salted_join`.

    Key and salt names may be alias-qualified (``l.l_partkey``), so this also works inside a join chain.
    """
    if salts < 1:
        raise ValueError("salts must be >= 1")
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("salted join needs equal, non-empty key lists")
    salt_from = salt_from or [c for c in left.columns if c not in left_keys]
    lsalt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_from]), F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot_fraction is None:
        return _shuffled(left.withColumn("__lsalt", lsalt)), _shuffled(right.withColumn("__rsalt", F.explode(all_salts)))

    total = left.count()
    threshold = max(1, int(total * hot_fraction))
    hot = (left.groupBy(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(left_keys)]).count()
           .filter(F.col("count") > threshold).drop("count")
           .withColumn("__is_hot", F.lit(True)))
    # at most 1/hot_fraction keys can hold more than a hot_fraction share: a proven bound for the broadcast
    hot = F.broadcast(hot)
    drop = [f"__hot_{i}" for i in range(len(left_keys))] + ["__is_hot"]
    on_l = _and([F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(left_keys)])
    on_r = _and([F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(right_keys)])
    left_s = (left.join(hot, on_l, "left")
              .withColumn("__lsalt", F.when(F.col("__is_hot"), lsalt).otherwise(F.lit(0)))
              .drop(*drop))
    right_s = (right.join(hot, on_r, "left")
               .withColumn("__rsalt", F.explode(F.when(F.col("__is_hot"), all_salts)
                                                .otherwise(F.array(F.lit(0)))))
               .drop(*drop))
    return _shuffled(left_s), _shuffled(right_s)


def add_salt_columns_right_skew(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                                salts: int = 8, salt_from: list[str] | None = None,
                                hot_fraction: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Salting for keys that are hot on the *right* side (the mirror of :func:`add_salt_columns`).

    Right rows of a hot key get ``__rsalt = pmod(xxhash64(salt_from), salts)``, and left rows of a hot key are
    replicated once per salt. The left gets ``__lhot``, and the right a ``__rmark`` that is null when a left
    row found no partner. Hot keys are read from the right side's key counts (at most ``1/hot_fraction``).
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("salted join needs equal, non-empty key lists")
    salt_from = salt_from or [c for c in right.columns if c not in right_keys]
    total = right.count()
    threshold = max(1, int(total * hot_fraction))
    hot = (right.groupBy(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(right_keys)]).count()
           .filter(F.col("count") > threshold).drop("count").withColumn("__is_hot", F.lit(True)))
    hot = F.broadcast(hot)
    drop = [f"__hot_{i}" for i in range(len(left_keys))] + ["__is_hot"]
    on_l = _and([F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(left_keys)])
    on_r = _and([F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(right_keys)])
    rsalt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_from]), F.lit(salts)).cast("int")
    left_s = (left.join(hot, on_l, "left")
              .withColumn("__lhot", F.coalesce(F.col("__is_hot"), F.lit(False)))
              .withColumn("__lsalt", F.explode(F.when(F.col("__lhot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                               .otherwise(F.array(F.lit(0)))))
              .drop(*drop))
    right_s = (right.join(hot, on_r, "left")
               .withColumn("__rsalt", F.when(F.col("__is_hot"), rsalt).otherwise(F.lit(0)))
               .withColumn("__rmark", F.lit(True))
               .drop(*drop))
    return _shuffled(left_s), _shuffled(right_s)


def salted_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                how: str = "inner", salts: int = 8, salt_from: list[str] | None = None,
                hot_fraction: float | None = None, extra_condition: str | None = None) -> DataFrame:
    """Equi-join where each left key is spread over ``salts`` sub-keys.

    The left side gets ``salt = pmod(xxhash64(salt_from), salts)`` from columns that vary *within* a key
    (deterministic, so a retried task reproduces the same rows); the right side is replicated once per salt
    value with ``explode(sequence(0, salts-1))``. Each (key, salt) pair then lands in its own shuffle
    partition, so one key holding a third of the rows is cut into ``salts`` tasks.

    With ``hot_fraction`` only keys holding more than that share of the left rows are salted: their list has
    at most ``1/hot_fraction`` entries by construction, so it is broadcast with a proven bound, and only
    those keys' right rows are replicated. Every other key keeps salt 0 and is joined as usual.

    Exact for inner, left, left semi and left anti joins. Right and full outer joins would null-extend every
    unmatched replica, so they are refused.
    """
    how = spark_join_type(how)
    if how not in SALTABLE:
        raise ValueError(f"salted join is only exact for {SALTABLE}, not {how!r}")
    left_s, right_s = add_salt_columns(left, right, left_keys, right_keys, salts, salt_from, hot_fraction)
    l = left_s.alias("__l")
    r = right_s.alias("__r")
    conds = [F.col(f"__l.{lk}") == F.col(f"__r.{rk}") for lk, rk in zip(left_keys, right_keys)]
    conds.append(F.col("__l.__lsalt") == F.col("__r.__rsalt"))
    if extra_condition:
        conds.append(F.expr(extra_condition))
    out = l.join(r, _and(conds), how)
    keep = [F.col(f"__l.{c}") for c in left.columns]
    if how not in ("left_semi", "left_anti"):
        keep += [F.col(f"__r.{c}") for c in right.columns]
    return out.select(*keep)


def salted_left_join_right_skew(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                                salts: int = 8, salt_from: list[str] | None = None,
                                hot_fraction: float = 0.001) -> DataFrame:
    """``left LEFT JOIN right`` on key equality with keys that are hot on the *right* side: left columns,
    then right columns (by position; names may repeat)."""
    rn = [f"__r{i}" for i in range(len(right.columns))]
    r = right.toDF(*rn)
    rk = [rn[right.columns.index(k)] for k in right_keys]
    sf = [rn[right.columns.index(c)] for c in salt_from] if salt_from else None
    ln = [f"__l{i}" for i in range(len(left.columns))]
    lft = left.toDF(*ln)
    lk = [ln[left.columns.index(k)] for k in left_keys]
    left_s, right_s = add_salt_columns_right_skew(lft, r, lk, rk, salts, sf, hot_fraction)
    terms = [F.col(a) == F.col(b) for a, b in zip(lk, rk)] + [F.col("__lsalt") == F.col("__rsalt")]
    df = left_s.join(right_s, _and(terms), "left").filter(~(F.col("__lhot") & F.col("__rmark").isNull()))
    return df.select(*[F.col(c).alias(o) for c, o in zip(ln, left.columns)],
                     *[F.col(c).alias(o) for c, o in zip(rn, right.columns)])


def _salted_left(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], salts: int,
                 salt_from: list[str] | None, hot_fraction: float | None, skewed_side: str) -> DataFrame:
    if skewed_side == "right":
        return salted_left_join_right_skew(left, right, left_keys, right_keys, salts, salt_from,
                                           hot_fraction if hot_fraction is not None else 0.001)
    return salted_join(left, right, left_keys, right_keys, "left", salts, salt_from, hot_fraction)


def salted_outer_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                      how: str = "full", salts: int = 8, salt_from: list[str] | None = None,
                      hot_fraction: float | None = None, skewed_side: str = "left") -> DataFrame:
    """Right and full outer equi-joins with salted hot keys, exactly.

    A salted join cannot be an outer join on the replicated side (each replica would be null-extended), so
    these are decomposed:

    * right: the left join with the sides swapped, columns put back in left-then-right order.
    * full: a left join (every left row, matched or null-extended), plus the right rows whose key has no
      partner on the left. That second part is an anti join against the *distinct* left keys, whose
      partial aggregation removes any hot key before the shuffle, with the left columns null.

    ``skewed_side`` names the side whose keys are hot (``salt_from`` names columns of that side). The left
    join inside is salted for exactly that side.
    """
    how = spark_join_type(how)
    if skewed_side not in ("left", "right"):
        raise ValueError("skewed_side must be 'left' or 'right'")
    if how == "right":
        # swapped: right LEFT JOIN left, so the hot side's role flips
        flipped = "right" if skewed_side == "left" else "left"
        swapped = _salted_left(right, left, right_keys, left_keys, salts, salt_from, hot_fraction, flipped)
        # positions, not names: the two sides may share column names
        nr = len(right.columns)
        tmp = swapped.toDF(*[f"__c{i}" for i in range(len(swapped.columns))])
        return tmp.select(*[F.col(f"__c{nr + i}").alias(c) for i, c in enumerate(left.columns)],
                          *[F.col(f"__c{i}").alias(c) for i, c in enumerate(right.columns)])
    if how != "full":
        raise ValueError("salted_outer_join handles right and full joins; use salted_join for the others")
    matched = _salted_left(left, right, left_keys, right_keys, salts, salt_from, hot_fraction, skewed_side)
    keys = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(left_keys)]).distinct()
    on = _and([F.col(rk) == F.col(f"__k{i}") for i, rk in enumerate(right_keys)])
    right_only = right.join(keys, on, "left_anti")
    padded = right_only.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields],
                               *[right_only[c] for c in right.columns])
    return matched.union(padded)


def _and(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out
