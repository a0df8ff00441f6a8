"""Command line: read a table, estimate and correct its drift, write it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.estimate import estimate_drift
from .schema import DriftConfig
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--input", "-i", required=True)
    p.add_argument("--output", "-o", required=True)
    p.add_argument("--segmentation_mode", "-sm", type=int, default=2, help="0: number of windows, 1: localizations per window, 2: frames per window")
    p.add_argument("--segmentation_var", "-sv", type=int, required=True)
    p.add_argument("--initial_sigma_nm", "-isig", type=float)
    p.add_argument("--target_sigma_nm", "-tsig", type=float, default=10)
    p.add_argument("--max_drift_nm", "-d", type=float, default=100)
    p.add_argument("--boxcar_width", type=int, default=1)
    p.add_argument("--interpolation", choices=("cubic", "natural", "catmull-rom", "linear", "spline"), default="cubic")
    p.add_argument("--format", choices=("csv", "parquet"), required=True)
    p.add_argument("--pixel_size_nm", type=float, default=160.0, help="of a molecule set that is written")
    p.add_argument("--rounds", help="a folder for the drift after every round of the optimizer")
    p.add_argument("--max_locs_per_segment", "-mlpseg", type=int)
    p.add_argument("--display", action="store_true", help="print the rounds of the optimizer")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    cfg = DriftConfig(a.segmentation_mode, a.segmentation_var, a.max_locs_per_segment, a.initial_sigma_nm, a.max_drift_nm, a.target_sigma_nm, a.boxcar_width, interpolation_method=a.interpolation)
    result = estimate_drift(readers.read(spark, a.input), cfg, rounds_to=a.rounds)
    if a.display:
        result.trace.show(100, False)
    if a.format == "csv" and a.input.endswith(".csv"):
        sinks.write_corrected_csv(readers.read_csv_all(spark, a.input), result.drift_frames, a.output)
    elif a.format == "csv":
        sinks.write_thunderstorm(result.corrected, a.output)
    else:
        sinks.write_molecule_set(result.corrected, a.output, a.pixel_size_nm)


if __name__ == "__main__":
    main()
