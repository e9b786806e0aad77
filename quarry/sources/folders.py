"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; without one, a temporary folder if Spark runs in this process.

    On a cluster other machines cannot read a temporary folder, so there it is an error not to name one.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.gettempdir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_base(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set the session's checkpoint folder where none is set yet."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = shared_base(spark)
        spark.sparkContext.setCheckpointDir(base if spark.sparkContext.getConf().get("spark.checkpoint.dir") else tempfile.mkdtemp(prefix="quarry-checkpoint-", dir=base))
