"""Histograms and value stretching over pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(px: DataFrame, low=None, high=None, value: str = "v") -> DataFrame:
    """(image_id, v, n): counts of the values within [low, high]."""
    v = F.col(value)
    if low is not None:
        px = px.filter(v >= low)
    if high is not None:
        px = px.filter(v <= high)
    return px.groupBy("image_id", v.alias("v")).agg(F.count("*").alias("n"))


def histogram_channel(px: DataFrame, bands: list[str], low=None, high=None) -> DataFrame:
    """Histogram of the second of three bands, of the first of any other number."""
    return histogram(px, low, high, bands[1] if len(bands) == 3 else bands[0])


def threshold(hist: DataFrame, ratio: float) -> DataFrame:
    """(image_id, threshold): the least value up to which `ratio` of all counts lie."""
    image = Window.partitionBy("image_id")
    cum = F.sum("n").over(image.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = hist.select("image_id", "v", cum.alias("cum"), F.sum("n").over(image).alias("total"))
    return reached.filter(F.col("cum") >= F.lit(ratio) * F.col("total")).groupBy("image_id").agg(F.min("v").alias("threshold"))


def prevalent(hist: DataFrame) -> DataFrame:
    """(image_id, v): the most frequent value, the smallest of equals."""
    return hist.groupBy("image_id").agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("v"))


def stretch(v: Column, low, high, most: int = 255) -> Column:
    """Values below low to 0, above high to most, linear and truncated in between; null if high equals low."""
    inner = F.floor(F.lit(float(most)) * (v - low) / F.nullif(F.lit(high - low), F.lit(0)))
    return F.when(v < low, 0).when(v > high, most).otherwise(inner).cast("int")
