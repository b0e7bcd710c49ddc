"""``python -m rampflow QUERY SF_DIR OUT``: run one registered query and write it as Parquet; without arguments list them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import registry


def main(args: list[str]) -> int:
    found = registry.queries()
    if len(args) != 3 or args[0] not in found:
        print("\n".join(sorted(found)))
        return 2 if args else 0
    spark = SparkSession.builder.getOrCreate()
    found[args[0]](spark, args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
