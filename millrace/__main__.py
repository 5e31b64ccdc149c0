"""python -m millrace SCRIPT [--search DIR] [--side-effects]: runs a script or an inline one and prints what it gives as TSV."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.flow import Flow
from millrace.plans.script import run_script
from millrace.sources.text import tsv_lines


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("script")
    args.add_argument("--search", action="append", default=[])
    args.add_argument("--side-effects", action="store_true")
    got = args.parse_args()
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out = run_script(spark, got.script, search=got.search, allow_side_effects=got.side_effects)
    if out is not None:
        for r in (tsv_lines(out) if isinstance(out, Flow) else out).toLocalIterator():
            print(r.value)


if __name__ == "__main__":
    main()
