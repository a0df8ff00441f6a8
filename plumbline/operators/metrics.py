"""Comparison of drift tables and summaries of localizations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DRIFT


def _beside(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on, *(F.col(c).alias(f"{c}_a") for c in DRIFT)).join(b.select(on, *(F.col(c).alias(f"{c}_b") for c in DRIFT)), on)


def _differences() -> list[Column]:
    return [F.col(f"{c}_a") - F.col(f"{c}_b") for c in DRIFT]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def error(estimate: DataFrame, truth: DataFrame, on: str = "frame") -> DataFrame:
    """One row: the mean over axes of the standard deviation of the difference, which a constant shift leaves alone."""
    return _beside(estimate, truth, on).agg((_sum([F.stddev_pop(d) for d in _differences()]) / 3).alias("error"))


def rms_change(a: DataFrame, b: DataFrame, on: str = "segment") -> DataFrame:
    """One row: the root of the mean squared change over all axes."""
    return _beside(a, b, on).agg(F.sqrt(F.avg(_sum([d * d for d in _differences()]) / 3)).alias("rms_change"))


def median_change(a: DataFrame, b: DataFrame, on: str = "segment") -> DataFrame:
    """One row: the median squared change of single coordinates."""
    each = _beside(a, b, on).select(F.explode(F.array(*(d * d for d in _differences()))).alias("c"))
    return each.agg(F.median("c").alias("median_change"))


def mean_distance(a: DataFrame, b: DataFrame, on: str = "frame") -> DataFrame:
    """One row: the mean length of the difference."""
    return _beside(a, b, on).agg(F.avg(F.sqrt(_sum([d * d for d in _differences()]))).alias("mean_distance"))


def mean_abs_difference(a: DataFrame, b: DataFrame, on: str = "frame") -> DataFrame:
    """One row: the mean absolute difference of whole tables; the frame column counts with its difference of 0."""
    return _beside(a, b, on).agg((F.avg(_sum([F.abs(d) for d in _differences()])) / 4).alias("mean_abs_difference"))


def range_ok(drift: DataFrame, max_drift: float, pixel_size: float = 1.0, aborted: bool = False) -> DataFrame:
    """One row: each axis' range, and whether none is above ``max_drift`` and the run was not aborted."""
    spans = drift.agg(*(((F.max(c) - F.min(c)) * pixel_size).alias(f"{c}_range") for c in DRIFT))
    return spans.withColumn("ok", reduce(lambda a, b: a & b, [F.col(f"{c}_range") <= max_drift for c in DRIFT]) & F.lit(not aborted))


def summary(locs: DataFrame) -> DataFrame:
    """One row: localizations, frames, the last frame, the largest absolute coordinate."""
    return locs.agg(F.count("*").alias("n_locs"), F.count_distinct("frame").alias("n_frames"), F.max("frame").alias("max_frame"), F.max(F.greatest(*(F.abs(c) for c in "xyz"))).alias("max_abs"))
