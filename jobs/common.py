"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("graphloom.jobs")


def default_config(module_file: str) -> dict[str, Any]:
    """The config that ships beside a job's module."""
    return json.loads(Path(module_file).with_suffix(".json").read_text())


def command_line(name: str, module_file: str, paths: Mapping[str, str], run: Callable[..., Any], argv: list[str] | None = None) -> None:
    """Parse plain path arguments, make a session, run the job, stop the session.

    paths: argument names with their help.  ``--config`` names a JSON file, read
    by Spark, whose entries replace those of the default config.
    """
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{Path(module_file).stem}", description=run.__doc__)
    for arg, text in paths.items():
        parser.add_argument(f"--{arg}", required=True, help=text)
    parser.add_argument("--config", help="JSON file that replaces entries of the default config")
    args = vars(parser.parse_args(argv))
    given = args.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = default_config(module_file) | (json.loads(spark.read.text(given, wholetext=True).first()[0]) if given else {})
        run(spark, **args, config=config)
    finally:
        spark.stop()
