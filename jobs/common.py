"""What the jobs' command lines share: settings from a JSON file and flags, a session, and the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def command_line(name: str, paths: list[str], run: Callable[..., object], argv: list[str] | None = None) -> None:
    """Run `run(spark, **settings)`: the config file's values, over which flags go.

    Only this function makes and stops a session. Settings under "spark" are the session's own.
    """
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"))
    for p in paths:
        parser.add_argument(f"--{p.replace('_', '-')}", dest=p)
    given = vars(parser.parse_args(argv))
    with open(given.pop("config")) as f:  # the job's own settings, not data
        settings = json.load(f)
    conf = settings.pop("spark", {})
    settings |= {k: v for k, v in given.items() if v is not None}
    missing = [p for p in paths if not settings.get(p)]
    if missing:
        parser.error("no path for " + ", ".join(missing))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config(map=conf).getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
