"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and driver and executors are one process, a temporary folder that is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ConfigError(f"spark.checkpoint.dir is not set: with the master {master} it must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
