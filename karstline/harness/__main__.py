"""python -m karstline.harness [--slice ID]... [--exchange] [--write FOLDER]: runs cases and prints a summary of each slice."""

from __future__ import annotations

import argparse
import sys

from karstline.harness.adapters import DuckAdapter, SparkAdapter
from karstline.harness.cases import CASES, slice_ids
from karstline.harness.reports import drift_report, summary, write
from karstline.session import build_session


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--slice", action="append", choices=slice_ids(), dest="slices")
    parser.add_argument("--exchange", action="store_true", help="compare with and without a strict exchange instead of with DuckDB")
    parser.add_argument("--write", metavar="FOLDER")
    told = parser.parse_args(args)
    spark = build_session("local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
    base = SparkAdapter(spark)
    other = SparkAdapter(spark, exchange=True) if told.exchange else DuckAdapter()
    names = ("spark", "spark-exchange" if told.exchange else "duckdb")
    drift = 0
    for slice_id in told.slices or slice_ids():
        cases = [c for c in CASES if c.slice_id == slice_id]
        results = {names[0]: {c.case_id: base.execute(c) for c in cases}, names[1]: {c.case_id: other.execute(c) for c in cases}}
        report = drift_report(slice_id, results[names[0]], results[names[1]], names)
        found = summary(report)
        drift += found["drift"]
        print(slice_id, found)
        if told.write:
            write(told.write, report, results)
    return int(drift > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
