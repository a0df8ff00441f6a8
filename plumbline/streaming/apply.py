"""A finished drift table applied to localizations as they arrive: a stream-static join, no state kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.drift import apply
from ..schema import LOCS


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Localizations from Parquet files that appear in a folder."""
    return spark.readStream.schema(LOCS).parquet(path)


def corrected_stream(stream: DataFrame, drift: DataFrame) -> DataFrame:
    return apply(stream, drift)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
