"""Make the package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: The one temporary folder of this process, where sessions on this machine have no shared one.
_local: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors unless their path has it already."""
    sc = spark.sparkContext
    on_path = str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not on_path and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        folder = tempfile.mkdtemp(prefix="corpuslake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver as they come
        sc.addPyFile(shutil.make_archive(f"{folder}/corpuslake", "zip", _ROOT, "corpuslake"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster sees, ``spark.checkpoint.dir``; a temporary one where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="corpuslake-"))
        base = _local[0]
    return base.rstrip("/")


def local_session(cpus: int | str = "*", name: str = "corpuslake", **conf: str) -> SparkSession:
    """A session on this machine, for tests, benchmarks and notebooks."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())
