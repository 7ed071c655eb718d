"""What the jobs' command lines share: settings from a small JSON file, log lines, a session."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging

from pyspark.sql import SparkSession


def load(spark: SparkSession, kind: type, path: str | None, given: dict[str, object]):
    """Settings of a dataclass: its defaults, then the file's (JSON, at any place Spark reads), then
    those of the command line.  Names that it hasn't are an error."""
    values: dict[str, object] = {}
    if path:
        values |= json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return kind(**(values | {k: v for k, v in given.items() if v is not None}))


def main(name: str, kind: type, run) -> None:
    """Command line of a job: --config FILE and every setting as an option."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", help="JSON file of settings")
    for field in dataclasses.fields(kind):
        parser.add_argument("--" + field.name.replace("_", "-"), type=type(field.default), help=f"default: {field.default!r}")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, load(spark, kind, given.pop("config"), given))
    finally:
        spark.stop()
