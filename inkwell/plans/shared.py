"""Tables written once to the folder that the driver and all executors share, and read again by several branches of a plan."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only in local mode, as other executors could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="inkwell-"))
    return f"file://{_own[0]}"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_results: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """The table written and read again. What is a `result` of a conversion stays until `clear`."""
    path = f"{folder(df.sparkSession)}/inkwell/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if result:
        _results.append((df.sparkSession, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def deleted(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            _delete(df.sparkSession, path)


def clear() -> None:
    """Deletes the results that conversions of this process have written; their tables can't be read any more."""
    while _results:
        _delete(*_results.pop())
