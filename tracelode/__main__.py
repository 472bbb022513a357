"""python -m tracelode REPORTS.json: ranking metrics of a method over a file of reports."""

import argparse

from pyspark.sql import SparkSession

from .functions.registry import METHODS
from .operators.scoring import AGGREGATES
from .plans.evaluate import metrics


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("reports")
    p.add_argument("--method", default="prefix_match", choices=sorted(METHODS))
    p.add_argument("--argument", type=float, action="append", default=[], help="of the method, in order; may repeat")
    p.add_argument("--aggregate", default="max", choices=AGGREGATES)
    p.add_argument("--trim", type=int, default=0, help="dotted components to drop from function names")
    p.add_argument("--keep-recursion", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    metrics(spark, a.reports, method=a.method, arguments=tuple(a.argument), aggregate=a.aggregate, trim=a.trim, remove_recursion=not a.keep_recursion).show(truncate=False)


if __name__ == "__main__":
    main()
