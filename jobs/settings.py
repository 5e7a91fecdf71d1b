"""A job's settings: a small JSON file over the defaults; unknown names are errors."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with the file's values in their place. The file is read by Spark, so its path may be remote."""
    if not path:
        return dict(defaults)
    own = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"unknown settings: {unknown}")
    return {**defaults, **own}


def main(run, name: str, paths: dict[str, str], defaults: dict) -> None:
    """The command line of a job: its paths and --config; makes a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for p, what in paths.items():
        parser.add_argument(f"--{p}", required=True, help=what)
    parser.add_argument("--config", help="a JSON file of settings: " + ", ".join(defaults))
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = load(spark, given.pop("config"), defaults)
        run(spark, **given, config=config)
    finally:
        spark.stop()
