"""Batch entry point: runs one query of the catalogue over a folder of tables and writes what it gives.

    spark-submit --py-files tessera.zip -m tessera.jobs NAME TABLES OUT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import catalog
from .session import prepare


def main(argv: list[str]) -> int:
    if len(argv) != 3 or argv[0] not in catalog.queries():
        print(f"usage: python -m tessera.jobs NAME TABLES OUT\nnames: {', '.join(sorted(catalog.queries()))}", file=sys.stderr)
        return 2
    name, tables, out = argv
    spark = prepare(SparkSession.builder.appName(f"tessera-{name}").getOrCreate())
    catalog.queries()[name](spark, tables).write.mode("overwrite").parquet(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
