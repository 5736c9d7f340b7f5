"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str, cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local session that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulselake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package where it is not on their path already."""
    package = Path(__file__).resolve().parent
    known = [os.path.realpath(x or ".") for x in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    with _shipping:
        if str(package.parent) in known or app in _shipped:
            return
        folder = tempfile.mkdtemp(prefix="pulselake-")  # the driver serves the file from there while it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for x in sorted(package.rglob("*.py")):
                z.write(x, x.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
