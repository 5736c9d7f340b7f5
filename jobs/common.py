"""What the jobs share: settings, command lines, logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("pulselake.jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's config file, shipped beside the code unless a path is given."""
    return json.loads(Path(path or Path(__file__).with_name(f"{name}.json")).read_text())


def main(name: str, job: Callable[..., dict], arguments: dict[str, str]) -> None:
    """Parse the command line, run the job in a session of its own, stop the session."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    for argument, text in arguments.items():
        parser.add_argument(f"--{argument}", required=True, help=text)
    parser.add_argument("--config", help=f"settings; {name}.json beside the code if not given")
    parser.add_argument("--master", help="master of the session; that of the Spark defaults if not given")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(given.master) if given.master else builder).getOrCreate()
    try:
        job(spark, *(getattr(given, a) for a in arguments), settings(name, given.config))
    finally:
        spark.stop()
