"""``python -m gridloom --config workflow.json --input pixels.parquet --output folder [--dry-run]``.

Runs a workflow document on a table ``z, y, x, v`` and writes the global
features, the feature map, the regions and a timing report as CSV.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from gridloom.plans import workflow
from gridloom.sources.files import write_table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--value", default="v")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    with open(args.config) as f:
        plan = workflow.parse(json.load(f))
    if args.dry_run:
        print("\n".join(workflow.explain(plan)))
        return 0
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    report, began = [], time.time()
    for name, df in workflow.run(spark.read.parquet(args.input), plan, args.value).items():
        if name != "selected":
            write_table(df, f"{args.output}/{name}")
            report.append((name, round(time.time() - began, 3)))
    write_table(spark.createDataFrame(report, "step string, seconds_so_far double").coalesce(1), f"{args.output}/timing")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
