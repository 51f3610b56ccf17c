"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Python workers are kept between tasks, several in an executor; these make them give freed memory back instead of keeping it.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(256 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver has it, and hold on to little memory.

    Elsewhere the package has to be installed or shipped (--py-files), as for any PySpark library. Settings of
    the worker environment that are there already stay.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, *paths) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir, which all machines share. Unset on a local master (tests): a temporary folder is set as it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
