"""The job spec: a dict (or JSON text) describing tables, joins, predicates, transformations and a target.

Two shapes are accepted and normalised into :class:`JobSpec`:

* ours: ``target = {schema, table, path, mode, partitions: [{column, value}], replace_partitions, columns}``
* the saved-job form: flat ``output_schema``, ``output_table``, ``write_mode`` and comma text
  ``partition_columns`` / ``partition_values``; ``transformations`` and friends may also be JSON text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..operators.joins import spark_join_type
from ..operators.transforms import KINDS, Transformation
from ..sources.sinks import WRITE_MODES, Target


@dataclass
class TableSpec:
    name: str
    alias: str
    schema: str | None = None
    path: str | None = None
    predicate: str | None = None


@dataclass
class JoinSpec:
    type: str
    conditions: str | None
    right_table: str | None = None
    left_table: str | None = None
    subquery: str | None = None
    left_alias: str | None = None
    right_alias: str | None = None
    strategy: str | None = None       # None (Spark decides) | "broadcast" | "salted"
    salt: dict | None = None          # salted join options: left_keys, right_keys, salts, hot_fraction
    band: dict | None = None          # band join options: low, high, point, width, range_side
    theta: dict | None = None         # grid join: bounds, bands, target_rows; overlap join: left, right, keys, width


@dataclass
class JobSpec:
    tables: list[TableSpec]
    joins: list[JoinSpec] = field(default_factory=list)
    predicates: str | None = None
    transformations: list[Transformation] = field(default_factory=list)
    target: Target | None = None
    preview: int | None = None
    settings: list[str] = field(default_factory=list)
    having: str | None = None   # over the output of group keys and aggregates


def _load(v: Any) -> Any:
    if isinstance(v, str):
        v = v.strip()
        return json.loads(v) if v else []
    return v if v is not None else []


def _commas(v: Any) -> list[str]:
    if v is None:
        return []
    if isinstance(v, (list, tuple)):
        return [str(x).strip() for x in v if str(x).strip()]
    return [x.strip() for x in str(v).split(",") if x.strip()]


def parse_spec(spec: dict | str) -> JobSpec:
    if isinstance(spec, str):
        spec = json.loads(spec)
    # A blank table row (the form's default) is dropped
    tables = [TableSpec(name=t["name"].strip(), alias=(t.get("alias") or t["name"]).strip(),
                        schema=(t.get("schema") or None), path=t.get("path"),
                        predicate=(t.get("predicate") or None))
              for t in _load(spec.get("tables")) if (t.get("name") or "").strip()]
    if not tables:
        raise ValueError("a job needs at least one table")
    aliases = [t.alias for t in tables]
    if len(set(aliases)) != len(aliases):
        raise ValueError(f"duplicate table aliases: {aliases}")

    joins = []
    chain = [tables[0].alias]
    for j in _load(spec.get("joins")):
        kind = (j.get("type") or "inner").strip().lower()
        js = JoinSpec(type=kind, conditions=j.get("conditions"), right_table=j.get("right_table"),
                      left_table=j.get("left_table"), subquery=j.get("subquery"),
                      left_alias=j.get("left_alias"), right_alias=j.get("right_alias"),
                      strategy=j.get("strategy"), salt=j.get("salt"), band=j.get("band"), theta=j.get("theta"))
        # left_table, when given, must already be in the chain
        if js.left_table and js.left_table not in chain and kind != "self":
            raise ValueError(f"join left_table {js.left_table!r} is not in the chain {chain}")
        if kind == "subquery":
            if not js.subquery:
                raise ValueError("a subquery join needs 'subquery' text")
            chain.append(js.right_alias or f"sq{len(joins)}")
        elif kind == "self":
            # The aliases must come with the spec
            if not (js.left_alias and js.right_alias):
                raise ValueError("a self join needs left_alias and right_alias")
            chain = [js.left_alias, js.right_alias]
        else:
            spark_join_type(kind)
            if js.right_table not in aliases:
                raise ValueError(f"join right_table {js.right_table!r} is not a table alias")
            chain.append(js.right_table)
        if js.strategy not in (None, "broadcast", "salted", "band", "grid", "overlap"):
            raise ValueError(f"unknown join strategy {js.strategy!r}")
        if kind == "self" and js.strategy:
            raise ValueError("a self join takes no strategy")
        if kind == "subquery" and js.strategy not in (None, "broadcast"):
            raise ValueError("a subquery join takes only the broadcast strategy")
        if js.strategy == "broadcast" and kind not in ("self", "subquery") and \
                spark_join_type(kind) in ("right", "full"):
            raise ValueError("a right or full join cannot build on (broadcast) its right side")
        if js.strategy == "salted" and not (js.salt and js.salt.get("left_keys") and js.salt.get("right_keys")):
            raise ValueError("a salted join needs salt.left_keys and salt.right_keys")
        if js.strategy == "salted" and js.salt.get("skewed_side", "left") not in ("left", "right"):
            raise ValueError("salt.skewed_side must be 'left' or 'right'")
        if js.strategy == "salted" and kind not in ("self", "subquery") and \
                spark_join_type(kind) in ("right", "full"):
            if (js.conditions or "").strip() or (js.salt or {}).get("condition"):
                raise ValueError("a salted right/full join takes key equality only (leave 'conditions' empty)")
            # the decomposition flattens the chain: later steps use bare names (as after a self join)
        if js.strategy == "band":
            b = js.band or {}
            if not all(b.get(k) for k in ("low", "high", "point", "width")):
                raise ValueError("a band join needs band.low, band.high, band.point and band.width")
            if spark_join_type(kind) != "inner":
                raise ValueError("a band join is only exact as an inner join")
        if js.strategy in ("grid", "overlap"):
            need = ("bounds",) if js.strategy == "grid" else ("left", "right")
            if not all((js.theta or {}).get(k) for k in need):
                raise ValueError(f"a join by {js.strategy} needs theta.{' and theta.'.join(need)}")
            if spark_join_type(kind) != "inner":
                raise ValueError(f"a join by {js.strategy} is only exact as an inner join")
        joins.append(js)

    trans = []
    for t in _load(spec.get("transformations")):
        if not (t.get("expression") or "").strip():
            continue
        if t.get("kind") and t["kind"] not in KINDS:
            raise ValueError(f"unknown transformation kind {t['kind']!r}")
        trans.append(Transformation(t.get("output_column") or "", t["expression"], t.get("kind"),
                                    t.get("skew_safe")))

    target = None
    tgt = spec.get("target")
    if tgt is None and spec.get("output_table"):
        cols, vals = _commas(spec.get("partition_columns")), _commas(spec.get("partition_values"))
        # Columns alone are dynamic partitions; unequal lengths are an error, not a silent zip
        if vals and len(vals) != len(cols):
            raise ValueError(f"{len(cols)} partition columns but {len(vals)} values")
        tgt = {"schema": spec.get("output_schema") or None, "table": spec["output_table"],
               "path": spec.get("output_path"), "mode": spec.get("write_mode") or "overwrite",
               "partitions": [{"column": c, "value": (vals[i] if vals else None)} for i, c in enumerate(cols)]}
    if tgt:
        mode = (tgt.get("mode") or "overwrite").lower()
        if mode not in WRITE_MODES:
            raise ValueError(f"write mode must be one of {WRITE_MODES}")
        parts = [(p["column"], p.get("value")) for p in (tgt.get("partitions") or [])]
        target = Target(table=tgt["table"], schema=tgt.get("schema") or None, path=tgt.get("path"), mode=mode,
                        partitions=parts, replace_partitions=bool(tgt.get("replace_partitions")),
                        columns=tgt.get("columns"), format=tgt.get("format"), rebalance=tgt.get("rebalance"),
                        bucket_by=tgt.get("bucket_by"), buckets=tgt.get("buckets"), sort_by=tgt.get("sort_by"))
        if target.bucket_by and (target.columns or target.replace_partitions):
            raise ValueError("a bucketed write takes neither a column list nor replace_partitions")

    settings = spec.get("settings") or []
    if isinstance(settings, str):
        settings = settings.splitlines()
    return JobSpec(tables=tables, joins=joins, predicates=spec.get("predicates") or None,
                   transformations=trans, target=target, preview=spec.get("preview"), settings=list(settings),
                   having=spec.get("having") or None)
