"""``python -m millrace index PATH [--format F]``: rows of each shard."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .sources import mds  # noqa: F401  registers its format
from .sources.readers import Dataset, shard_index


def main(args: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="count the rows of each shard")
    index.add_argument("path")
    index.add_argument("--format")
    index.add_argument("--output", help="folder for the counts as JSON lines")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName("millrace index").getOrCreate()
    counts = shard_index(Dataset.from_path("index", chosen.path, fmt=chosen.format).load(spark)).orderBy("shard_id")
    if chosen.output:
        counts.write.mode("overwrite").json(chosen.output)
        return {"output": chosen.output}
    found = {"shards": [{"name": r["_shard"], "rows": r["num_rows"]} for r in counts.toLocalIterator()]}
    print(json.dumps(found))
    return found


if __name__ == "__main__":
    main()
