"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_written: dict[str, SparkSession] = {}  # every table that is still there, for the end of the process
_own = threading.local()


def _mine() -> list[str]:
    """The tables this thread has written, in order. Callers in other threads have lists of their own, so none drops another's."""
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            drop(spark, path)
        except Exception:  # the session may be gone already
            return


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that goes at the end of the process."""
    path = f"{shared_dir(spark).rstrip('/')}/pulselake/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    _mine().append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them back: lineage ends here and nothing is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where this thread's list of written tables stands now, for ``settled``."""
    return len(_mine())


def release(since: int, keep: int = 0) -> None:
    """Delete the tables that this thread has written since ``since`` but the last ``keep``."""
    mine = _mine()
    done = mine[since : len(mine) - keep]
    for path in done:
        drop(_written.pop(path), path)
    del mine[since : since + len(done)]


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``stored``, and the tables this thread has written since ``since``, which only these rows needed, go at once."""
    out = stored(df, name)
    release(since, keep=1)
    return out


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_labels(spark: SparkSession, copies: int = 1) -> list[int]:
    """Different integers, ``copies`` for each of the session's shuffle partitions, that a shuffle by hash deals evenly.

    Label i goes to the same partition as label i + the number of partitions. Groups
    named 0, 1, 2, ... would fall on the partitions at random, many on some and none
    on others. Only the balance hangs on this, no result.
    """
    n = partitions(spark)
    found = spark.range(n * copies * 16).select(F.col("id").cast("int").alias("label")).withColumn("at", F.pmod(F.hash("label"), F.lit(n)))
    by: dict[int, list[int]] = {}
    for label, at in found.collect():  # 16 rows a label
        by.setdefault(at, []).append(label)
    own = [(by.get(at, [])[i : i + 1] or [-1 - at - n * i])[0] for i in range(copies) for at in range(n)]
    return own
