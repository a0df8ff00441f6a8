"""Drift tables: frames, interpolation, application, comparison. A drift table has ``frame`` (or ``segment``), dx, dy, dz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import AXES, DRIFT


def frame_axis(spark: SparkSession, last: int) -> DataFrame:
    """All frame numbers from 0 to ``last``, whatever the first observed one is."""
    return spark.range(0, last + 1).select(F.col("id").cast("int").alias("frame"))


def frame_axis_of(locs: DataFrame) -> DataFrame:
    return locs.agg(F.max("frame").alias("last")).filter("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0), "last")).alias("frame"))


def _intervals(frames: DataFrame, knots: DataFrame, lead: dict[str, Column], outside: bool) -> DataFrame:
    """Each frame beside the last knot at or before it (``outside``: frames before the first knot get the first).

    Only the knots, a row per segment, are put in order as a whole. Each is spread over the frames up to the next, and
    the frames meet it by an equi-join, so that no task sees all frames.
    """
    w = Window.orderBy("center_frame")
    known = knots.select(F.col("center_frame").alias("x1"), F.lead("center_frame").over(w).alias("__next"), F.lag("center_frame").over(w).isNull().alias("__first"), *(c.alias(k) for k, c in lead.items()))
    ends = frames.agg(F.min("frame").alias("__least"), F.max("frame").alias("__most")).filter("__most IS NOT NULL")
    lo, hi = F.ceil("x1").cast("int"), F.coalesce(F.ceil("__next").cast("int") - 1, F.greatest("__most", F.ceil("x1").cast("int")))
    if outside:
        lo = F.when(F.col("__first"), F.least("__least", lo)).otherwise(lo)
    spread = known.crossJoin(F.broadcast(ends)).withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi")  # one row
    spread = spread.select(F.explode(F.sequence("__lo", "__hi")).alias("frame"), "x1", *lead)
    return frames.join(spread, "frame", "left")


def catmull_rom(frames: DataFrame, knots: DataFrame, whole_numbers: bool = False) -> DataFrame:
    """Through the knots (center_frame, dx, dy, dz) from the second to the last but one; 0 outside of those.

    ``whole_numbers`` cuts the values off toward 0.
    """
    w = Window.orderBy("center_frame")
    lead = {"x2": F.lead("center_frame").over(w), "inner": F.lag("center_frame").over(w).isNotNull() & F.lead("center_frame", 2).over(w).isNotNull(), "last": F.lead("center_frame").over(w).isNotNull() & F.lead("center_frame", 2).over(w).isNull() & F.lag("center_frame", 2).over(w).isNotNull()}
    for c in DRIFT:
        lead |= {f"{c}0": F.lag(c).over(w), f"{c}1": F.col(c), f"{c}2": F.lead(c).over(w), f"{c}3": F.lead(c, 2).over(w)}
    at = _intervals(frames, knots, lead, False)
    t = (F.col("frame") - F.col("x1")) / (F.col("x2") - F.col("x1"))

    def value(c: str) -> Column:
        y0, y1, y2, y3 = (F.col(f"{c}{k}") for k in range(4))
        p = 0.5 * (2 * y1 + (y2 - y0) * t + (2 * y0 - 5 * y1 + 4 * y2 - y3) * t * t + (3 * y1 - y0 - 3 * y2 + y3) * t * t * t)
        v = F.when(F.col("inner"), p).when(F.col("last") & (F.col("frame") == F.col("x1")), y1).otherwise(0.0)
        v = F.coalesce(v, F.lit(0.0))
        return (v.cast("int").cast("double") if whole_numbers else v).alias(c)

    return at.select("frame", *map(value, DRIFT))


def linear(frames: DataFrame, knots: DataFrame) -> DataFrame:
    """Straight lines through the knots, carried on beyond both ends."""
    w = Window.orderBy("center_frame")
    lead: dict[str, Column] = {}
    for c, name in (("center_frame", "x"), *((d, d) for d in DRIFT)):
        # the last knot starts no interval: it takes the one before
        later = F.lead(c).over(w)
        lead |= {f"{name}_a": F.when(later.isNotNull(), F.col(c)).otherwise(F.coalesce(F.lag(c).over(w), F.col(c))), f"{name}_b": F.coalesce(later, F.col(c))}
    at = _intervals(frames, knots, lead, True)
    t = F.when(F.col("x_b") == F.col("x_a"), 0.0).otherwise((F.col("frame") - F.col("x_a")) / (F.col("x_b") - F.col("x_a")))
    return at.select("frame", *((F.col(f"{c}_a") + t * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c in DRIFT))


def step(frame_segments: DataFrame, drift: DataFrame) -> DataFrame:
    """Each frame's drift is that of its own segment."""
    return frame_segments.join(drift.select("segment", *DRIFT), "segment").select("frame", *DRIFT)


def polynomial(frames: DataFrame, pieces: DataFrame) -> DataFrame:
    """Evaluates cubic pieces (center_frame: where each begins; dx_c0 .. dz_c3), the first and last carried on outside."""
    lead = {f"{c}_c{k}": F.col(f"{c}_c{k}") for c in DRIFT for k in range(4)}
    at = _intervals(frames, pieces, lead, True)
    t = F.col("frame") - F.col("x1")
    return at.select("frame", *((((F.col(f"{c}_c3") * t + F.col(f"{c}_c2")) * t + F.col(f"{c}_c1")) * t + F.col(f"{c}_c0")).alias(c) for c in DRIFT))


def apply(locs: DataFrame, drift: DataFrame) -> DataFrame:
    """Takes each frame's drift off its localizations. A frame that the drift table lacks is an error, never a null."""
    both = locs.join(drift.select("frame", *DRIFT), "frame", "left")
    off = lambda d: F.when(F.col(d).isNull(), F.raise_error(F.concat(F.lit("no drift for frame "), F.col("frame").cast("string")))).otherwise(F.col(d))
    moved = {a: F.col(a) - off(d) for a, d in zip(AXES, DRIFT, strict=True)}
    return both.select(*(moved[c].alias(c) if c in moved else F.col(f"`{c}`") for c in locs.columns))


def centered(drift: DataFrame) -> DataFrame:
    """The trajectory less its mean."""
    mean = drift.agg(*(F.avg(c).alias(f"{c}_mean") for c in DRIFT))
    return drift.crossJoin(F.broadcast(mean)).select("frame", *((F.col(c) - F.col(f"{c}_mean")).alias(c) for c in DRIFT))  # one row
