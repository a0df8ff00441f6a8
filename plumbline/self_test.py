"""Self-test: a made-up table with a known drift must come back within a nanometre."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import metrics as M
from .plans.estimate import DriftResult, estimate_drift
from .schema import DriftConfig
from .sources import synthetic

#: The size of the self-test and its settings.
SITES, FRAMES, PER_FRAME, WITHIN_NM = 1000, 500, 120, 1.0
CONFIG = DriftConfig(2, 2, None, 120, 100, 10, local_bytes=256 << 20)  # one machine


def recovered(spark: SparkSession, sites: int = SITES, frames: int = FRAMES, per_frame: int = PER_FRAME) -> tuple[DriftResult, DataFrame]:
    """The estimate, and the drift that was put in."""
    return estimate_drift(synthetic.sites_in_cube(spark, sites, frames, per_frame), CONFIG), synthetic.waveform(spark, frames)


def main(spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("plumbline self-test").getOrCreate()
    result, truth = recovered(spark)
    error = M.error(result.drift_frames, truth).first()["error"]
    good = error < WITHIN_NM
    print(f"mean deviation per axis: {error:.3f} nm ({'pass' if good else 'FAIL'})")
    return 0 if good else 1


if __name__ == "__main__":
    raise SystemExit(main())
