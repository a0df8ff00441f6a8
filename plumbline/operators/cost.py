"""Overlap cost of a drift estimate and its gradient, as aggregations over pairs.

With e = d0 - (mu_ti - mu_tj) of a pair, the weight is exp(-|e|^2 / scale) * norm, the cost minus its sum, and the gradient
adds -/+ 2 w e / scale at segments ti and tj. The kernel has scale (2 sigma)^2 and norm 1 / sigma; the ``plain`` kernel
has a scale of its own, norm 1, a drift that is added, and a gradient of the opposite sign.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DRIFT


@dataclass(frozen=True)
class Kernel:
    scale: float
    norm: float = 1.0
    #: -1: the drift is taken off the positions; +1: it is added, and the gradient's sign turns with it.
    sign: int = -1
    axes: tuple[str, ...] = DRIFT


def gaussian(sigma: float) -> Kernel:
    return Kernel(4.0 * sigma * sigma, 1.0 / sigma)


def plain(scale: float, dims: int = 3) -> Kernel:
    return Kernel(scale, 1.0, +1, DRIFT[:dims])


#: Segments up to which a drift travels to the pairs; a larger one is joined by shuffles.
FEW = 100_000


def few(mu: DataFrame) -> DataFrame:
    """The drift as a table of known size where it has ``FEW`` rows or fewer: Spark then broadcasts it."""
    rows = mu.limit(FEW + 1).toArrow()
    return mu.sparkSession.createDataFrame(rows) if 0 < rows.num_rows <= FEW else mu


def with_drift(pairs: DataFrame, mu: DataFrame, kernel: Kernel) -> DataFrame:
    """Pairs (segment_i, segment_j, dx0 ...) with the residuals ex, ey, ez and the weight w. ``mu``: segment, dx, dy, dz."""
    mu = few(mu.select("segment", *kernel.axes))
    side = lambda s: mu.select(F.col("segment").alias(f"segment_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in kernel.axes))
    both = pairs.join(side("i"), "segment_i").join(side("j"), "segment_j")
    e = {c: F.col(f"{c}0") + kernel.sign * (F.col(f"{c}_i") - F.col(f"{c}_j")) for c in kernel.axes}
    both = both.select("segment_i", "segment_j", *(e[c].alias(f"e{c[1]}") for c in kernel.axes))
    square = sum((F.col(f"e{c[1]}") * F.col(f"e{c[1]}") for c in kernel.axes[1:]), F.col(f"e{kernel.axes[0][1]}") * F.col(f"e{kernel.axes[0][1]}"))
    return both.withColumn("w", F.exp(-square / kernel.scale) * kernel.norm)


def cost(pairs: DataFrame, mu: DataFrame, kernel: Kernel) -> DataFrame:
    """One row: cost; 0 without pairs. Without the gradient's sums, their columns are never computed."""
    return with_drift(pairs, mu, kernel).agg(F.coalesce(-F.sum("w"), F.lit(0.0)).alias("cost"))


def by_segment_pair(pairs: DataFrame, mu: DataFrame, kernel: Kernel) -> DataFrame:
    """Weights and first moments per pair of segments: what cost and gradient are made of."""
    moment: list[Column] = [F.sum(F.col("w") * F.col(f"e{c[1]}")).alias(f"m{c[1]}") for c in kernel.axes]
    return with_drift(pairs, mu, kernel).groupBy("segment_i", "segment_j").agg(F.count("*").alias("n_pairs"), F.sum("w").alias("w"), *moment)


def gradient(pairs: DataFrame, mu: DataFrame, kernel: Kernel) -> DataFrame:
    """segment, gx, gy, gz; segments without pairs to others are not listed.

    Pairs are summed by segment pair once (map-side first); only those sums are turned both ways.
    """
    sums = by_segment_pair(pairs, mu, kernel).filter("segment_i <> segment_j")
    f = 2.0 / kernel.scale * kernel.sign
    at = lambda s, sign: sums.select(F.col(f"segment_{s}").alias("segment"), *((sign * f * F.col(f"m{c[1]}")).alias(f"g{c[1]}") for c in kernel.axes))
    # taken off (sign -1): -2we/s at i, +2we/s at j. Added (sign +1): +2we/s at i, -2we/s at j.
    return at("i", 1.0).unionByName(at("j", -1.0)).groupBy("segment").agg(*(F.sum(f"g{c[1]}").alias(f"g{c[1]}") for c in kernel.axes))
