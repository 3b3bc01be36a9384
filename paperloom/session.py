"""Session for tests, the bench and local use. On a cluster the caller brings its own."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "paperloom") -> SparkSession:
    partitions = str(os.cpu_count() if cores == "*" else cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate tables, below ``spark.checkpoint.dir``.

    Executors may be lost, so this must be storage that all of them share. Only a single-process
    session without the setting, as in tests, gets a temporary folder of its own; it is removed when
    the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base}/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="paperloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
