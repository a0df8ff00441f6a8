"""Corrected localizations and images of a measurement: python -m jobs.render --config jobs/render.json --input ... --output ...

Drift is taken off every localization, and each channel is rendered as an image: the number of localizations in every
pixel, before and after. The drift is a finished table (frame, x_nm, y_nm, z_nm, as the library writes it) or, without
one, is estimated from all channels together, which move as one.

    corrected/  all localizations at their corrected positions, by channel
    images/     of each channel the pixels that are not empty, in tiles
    summary/    of each channel: localizations, pixels, and sharpness (the sum of squared pixels) before and after

``channels`` limits a run to some channels. A run replaces all of the channels that it works on and no others (dynamic
overwrite by channel), so that it may be done again at any time, after a failure or with another drift. Rows of a pixel
are folded before the shuffle; a tile holds tile_px * tile_px pixels at most. A localization in a frame that the drift
table lacks is an error.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.plans.estimate import estimate_drift
from plumbline.schema import DriftConfig

from .common import LOC, begin, configured, logged, read_locs


@dataclass(frozen=True)
class Render:
    input: str = ""
    output: str = ""
    #: A CSV table of the drift; without it, it is estimated.
    drift: str = ""
    #: SQL expressions of the input's columns, ``channel`` among them.
    columns: dict[str, str] = field(default_factory=lambda: {c: c for c in (*LOC, "channel")})
    channels: tuple[str, ...] = ()
    pixel_nm: float = 20.0
    tile_px: int = 256
    #: Settings of the estimate (see ``DriftConfig``).
    estimate: dict = field(default_factory=dict)


def drift_of(spark: SparkSession, cfg: Render, locs: DataFrame) -> DataFrame:
    if not cfg.drift:
        return estimate_drift(locs.select(*LOC), DriftConfig(**cfg.estimate)).drift_frames
    table = spark.read.option("header", True).schema("frame double, x_nm double, y_nm double, z_nm double").csv(cfg.drift)
    return table.select(F.col("frame").cast("int").alias("frame"), *(F.col(f"{a}_nm").alias(f"d{a}") for a in "xyz"))


def rendered(locs: DataFrame, pixel_nm: float, tile_px: int) -> DataFrame:
    """channel, tile_x, tile_y, px, py, before, after of localizations at two places (x, y and x0, y0)."""
    pixel = lambda x, y, b, a: locs.select("channel", F.floor(F.col(x) / pixel_nm).alias("px"), F.floor(F.col(y) / pixel_nm).alias("py"), F.lit(b).alias("b"), F.lit(a).alias("a"))
    both = pixel("x0", "y0", 1, 0).unionByName(pixel("x", "y", 0, 1))
    counts = both.groupBy("channel", "px", "py").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    tile = {f"tile_{a}": F.floor(F.col(f"p{a}") / tile_px) for a in "xy"}
    return counts.withColumns(tile)


def _put(df: DataFrame, path: str) -> None:
    """Replaces the channels that the rows belong to, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel").parquet(path)


def read(spark: SparkSession, cfg: Render, table: str) -> DataFrame:
    kinds = {
        "corrected": f"{', '.join(f'{c} {k}' for c, k in LOC.items())}, x0 double, y0 double, z0 double, channel string",
        "images": "px long, py long, before long, after long, tile_x long, tile_y long, channel string",
        "summary": "n_locs long, n_pixels long, sharp_before long, sharp_after long, channel string",
    }
    return spark.read.schema(kinds[table]).parquet(f"{cfg.output}/{table}")


def run(spark: SparkSession, cfg: Render) -> DataFrame:
    """Corrects and renders, and returns the images of all channels that there are."""
    if not cfg.input or not cfg.output:
        raise ValueError("render needs an input and an output")
    locs = read_locs(spark, cfg.input, cfg.columns, ("channel",)).withColumns({f"{a}0": F.col(a) for a in "xyz"})
    drift = drift_of(spark, cfg, locs)
    mine = locs.filter(F.col("channel").isin(*cfg.channels)) if cfg.channels else locs
    _put(D.apply(mine, drift), f"{cfg.output}/corrected")
    done = read(spark, cfg, "corrected")
    done = done.filter(F.col("channel").isin(*cfg.channels)) if cfg.channels else done
    images = rendered(done, cfg.pixel_nm, cfg.tile_px)
    _put(images.repartition("channel", "tile_x", "tile_y").sortWithinPartitions("channel", "tile_x", "tile_y", "px", "py"), f"{cfg.output}/images")
    drawn = read(spark, cfg, "images")
    drawn = drawn.filter(F.col("channel").isin(*cfg.channels)) if cfg.channels else drawn
    summary = drawn.groupBy("channel").agg(
        F.sum("after").alias("n_locs"), F.count("*").alias("n_pixels"), F.sum(F.col("before") * F.col("before")).alias("sharp_before"), F.sum(F.col("after") * F.col("after")).alias("sharp_after")
    )
    _put(summary.coalesce(1), f"{cfg.output}/summary")
    counts = read(spark, cfg, "summary").agg(F.count("*"), F.coalesce(F.sum("n_locs"), F.lit(0)), F.coalesce(F.sum("n_pixels"), F.lit(0))).first()
    logged("render", input=cfg.input, rows_read=mine.count(), drift=cfg.drift or "estimated")
    logged("render", output=cfg.output, channels=counts[0], localizations=counts[1], pixels=counts[2])
    return read(spark, cfg, "images")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.render", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="settings as JSON")
    p.add_argument("--input", help="a Parquet table")
    p.add_argument("--output", help="the folder of the tables")
    p.add_argument("--drift", help="a drift table as CSV; estimated without it")
    p.add_argument("--channels", nargs="+", help="these channels only")
    a = p.parse_args(argv)
    began = begin()
    spark = SparkSession.builder.appName("render").getOrCreate()
    try:
        run(spark, configured(Render, spark, a.config, {k: v for k, v in vars(a).items() if k != "config"}))
        logged("render", seconds=round(time.monotonic() - began, 1))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
