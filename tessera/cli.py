"""Export and import of stores: ``python -m tessera.cli export -d STORE -o FOLDER`` and ``... import -d STORE -i FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans.store import RecordStore
from tessera.sources.snapshot import commit, reopen


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("action", choices=["export", "import"])
    parser.add_argument("-d", required=True, help="the store's folder")
    parser.add_argument("-n", type=int, default=None, help="the snapshot to export, the last one by default")
    parser.add_argument("-o", help="where to export: Parquet of (recid, state, payload)")
    parser.add_argument("-i", help="what to import, as exported")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if options.action == "export":
        reopen(spark, options.d, options.n).state.write.mode("errorifexists").parquet(options.o)
    else:
        commit(RecordStore(spark.read.parquet(options.i)), options.d)


if __name__ == "__main__":
    main()
