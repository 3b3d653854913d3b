"""Image files as they arrive, through the same transforms as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers
from ..sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, path: str, pattern: str | None = None, per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new files in a folder."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def sizes(stream: DataFrame) -> DataFrame:
    """Path, type and size of each file; files of unknown type are left out."""
    known = stream.withColumn("mime", headers.image_mime(F.col("content"))).filter("mime <> ''")
    return known.select("path", "mime", headers.image_size(F.col("content")).alias("size"))


def decoded(stream: DataFrame) -> DataFrame:
    """Rasters of each file, nulls where one cannot be read."""
    return files.decode_images(stream, permissive=True)


def arrivals(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Files and bytes by window of their time; files later than the watermark are dropped."""
    timed = stream.select("modificationTime", "length").withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
