"""python -m kausal [dataset] [reference graph]: prints the report of a case."""

import sys

from pyspark.sql import SparkSession

from .plans.api import run_case

if __name__ == "__main__":
    print(run_case(SparkSession.builder.appName("kausal").getOrCreate(), *sys.argv[1:3]))
