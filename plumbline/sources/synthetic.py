"""Generators with a known drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def waveform(spark: SparkSession, n_frames: int = 500) -> DataFrame:
    """frame, dx, dy, dz: two waves and a ramp; the axes go by 1, 0.7 and -0.5."""
    t = F.col("id").cast("double")
    base = (3 * F.sin(t / 20.0 + 0.37) + 1.25 * F.cos(t / 6.0 + 1.2) + t / 25) * 10.0
    return spark.range(n_frames).select(F.col("id").cast("int").alias("frame"), base.alias("dx"), (base * 0.7).alias("dy"), (base * -0.5).alias("dz"))


def share(of: Column, seed: int, salt: int) -> Column:
    """A number from 0 up to 1 for each value, from the first 40 bits of a digest: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", of.cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 10), 16, 10).cast("double") / float(1 << 40)


def sites_in_cube(spark: SparkSession, n_sites: int = 1000, n_frames: int = 500, per_frame: int = 120, seed: int = 123) -> DataFrame:
    """Localizations of sites in a cube of 1000 nm, each frame seeing ``per_frame`` of them at random, drifted by the waveform.

    Every row's site follows from its number, so that lost tasks make the same rows again.
    """
    rows = spark.range(n_frames * per_frame).select(F.col("id").alias("loc_id"), F.floor(F.col("id") / per_frame).cast("int").alias("frame"), F.floor(share(F.col("id"), seed, 0) * n_sites).alias("site"))
    at = rows.join(waveform(spark, n_frames), "frame")
    return at.select("loc_id", *((share(F.col("site"), seed, k + 1) * 1000.0 + F.col(f"d{a}")).alias(a) for k, a in enumerate("xyz")), "frame")


def template(spark: SparkSession, sites: DataFrame, n_frames: int = 20) -> DataFrame:
    """The same sites (site_id, x, y) in every frame; dx a wave on a ramp to 20, dy a ramp to 5, z 0."""
    last = float(max(1, n_frames - 1))
    t = F.col("frame") / last
    frames = spark.range(n_frames).select(F.col("id").cast("int").alias("frame"))
    both = sites.crossJoin(frames)  # the product is what is asked for
    return both.select((F.col("frame") * 1_000_000 + F.col("site_id")).cast("long").alias("loc_id"), (F.col("x") + 5 * F.sin(t * (4 * math.pi)) + t * 20.0).alias("x"), (F.col("y") + t * 5.0).alias("y"), F.lit(0.0).alias("z"), "frame")


def blinking(spark: SparkSession, n_molecules: int = 20, per_molecule: int = 40, n_frames: int = 100, precision: float = 0.05, size: float = 10.0, seed: int = 1) -> DataFrame:
    """Molecules in a box, each seen at random times with Gaussian error, under a linear drift of 2, 5 and -3 precisions."""
    rows = spark.range(n_molecules * per_molecule).select(F.col("id").alias("loc_id"), F.floor(F.col("id") / per_molecule).alias("m"))
    normal = lambda salt: F.sqrt(-2 * F.log(1 - share(F.col("loc_id"), seed, salt))) * F.cos(2 * math.pi * share(F.col("loc_id"), seed, salt + 1))
    rows = rows.withColumn("frame", F.floor(share(F.col("loc_id"), seed, 9) * n_frames).cast("int"))
    return rows.select("loc_id", *((share(F.col("m"), seed, 20 + k) * size + normal(30 + 2 * k) * precision + F.col("frame") / float(n_frames) * (f * precision)).alias(a) for k, (a, f) in enumerate((("x", 2.0), ("y", 5.0), ("z", -3.0)))), "frame")
