"""Conversion of a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators.routing import Registry
from inkwell.plans.convert import Options, convert
from inkwell.sources.files import described

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000, delay: str = "1 day") -> DataFrame:
    """A stream of files (doc_id, content, info); a file delivered again within the delay counts once."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    fresh = files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "modificationTime"])
    return described(fresh)


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options | None = None, registry: Registry | None = None, available_now: bool = True, **source):
    """Starts a query that writes the documents of a folder as Parquet, a folder `batch=N` below `out` for each batch, which a
    batch that runs again replaces. With `available_now` it ends when all are done."""

    def write(files: DataFrame, batch: int) -> None:
        convert(files, options, registry).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = stream(spark, path, **source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
