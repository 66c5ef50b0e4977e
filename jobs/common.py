"""What the jobs share: configs, logs, and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("helixframe.jobs")


def settings(path: str | None, defaults: dict) -> dict:
    """The defaults with what a local JSON file says in their place; a name that isn't known is an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def exact_glob(path: str) -> str:
    """A pattern that matches this path alone.  A file stream takes a single file only as what a pattern matches; folders it takes both ways."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def command_line(name: str, paths: list[str], run) -> None:
    """Parse --config and a path for each name, create a session, run(spark, config path, *paths), and stop the session."""
    parser = argparse.ArgumentParser(prog=name)
    parser.add_argument("--config")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args.config, *[getattr(args, p) for p in paths])
    finally:
        spark.stop()
