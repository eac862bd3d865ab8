"""Run a saved job spec: ``python -m sparkwright job.json [--preview N] [--settings FILE] [--explain]``.

The spec may be in our form or in the saved-job form (tables, joins, predicates, transformations,
output_table, output_schema, write_mode, partition_columns, partition_values). Submit it with
``spark-submit -m sparkwright ...`` or run it against a local session.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sparkwright", description="Run a job spec as one Spark plan.")
    ap.add_argument("spec", help="path to the job spec (JSON)")
    ap.add_argument("--preview", type=int, default=0, help="print the first N result rows")
    ap.add_argument("--settings", help="file of 'key = value' Spark settings (lines not starting 'spark.' ignored)")
    ap.add_argument("--explain", action="store_true",
                    help="print the formatted physical plan of the job's result and stop (nothing is written)")
    args = ap.parse_args(argv)

    from .functions.conf import apply_settings
    from .plans.run import run_job
    from .session import build_session

    with open(args.spec) as f:
        spec = json.load(f)
    spark = build_session()
    if args.settings:
        with open(args.settings) as f:
            report = apply_settings(spark, f.read())
        if report["skipped"]:
            print(f"not modifiable at runtime (set them at submit time): {report['skipped']}", file=sys.stderr)
    if args.explain:
        from .plans.run import build_frame

        build_frame(spark, spec).explain("formatted")
        return 0
    df = run_job(spark, spec)
    if args.preview:
        df.show(args.preview, truncate=False)
    elif not (spec.get("target") or spec.get("output_table")):
        df.write.format("noop").mode("overwrite").save()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
