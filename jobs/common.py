"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(name: str, about: str, paths: dict[str, str], run: Callable, argv: list[str] | None = None) -> None:
    """Parses path arguments and a config file, starts a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--config", default=None, help="JSON file of the job's settings; jobs/*.json are examples")
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    given = vars(parser.parse_args(argv))
    config = given.pop("config")
    settings = {}
    if config:
        with open(config, encoding="utf-8") as f:
            settings = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **given, **settings)
    finally:
        spark.stop()
