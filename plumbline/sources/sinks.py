"""Sinks: corrected tables, drift tables, details of a correction. Spark writes folders of part files unless ``single``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.drift import apply
from ..operators.ordered import numbered
from .readers import CSV_AXES, FRAME


def three(c: str | Column) -> Column:
    """Three decimals, as text."""
    return F.format_string("%.3f", F.col(c) if isinstance(c, str) else c)


def _write(df: DataFrame, path: str, single: bool, header: bool = True) -> None:
    df = df.coalesce(1) if single else df
    df.write.mode("overwrite").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def corrected_csv(table: DataFrame, drift: DataFrame) -> DataFrame:
    """A ThunderSTORM table with all its columns, drift taken off, numbers with a fraction to three decimals."""
    axes = [c for c in CSV_AXES if c in table.columns]
    names = {c: f"__{k}" for k, c in enumerate(table.columns)}
    safe = table.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{FRAME}`").cast("double").cast("int").alias("frame"))
    for a in "xyz":
        column = f"{a} [nm]"
        safe = safe.withColumn(a, F.col(names[column]).cast("double") if column in axes else F.lit(0.0))
    moved = apply(safe, drift)
    real = {f.name for f in table.schema if f.dataType.typeName() in ("double", "float")}
    return moved.select(*((three(c[0]) if c in axes else three(names[c]) if c in real else F.col(names[c])).alias(c) for c in table.columns))


def write_corrected_csv(table: DataFrame, drift: DataFrame, path: str, single: bool = True) -> None:
    _write(corrected_csv(table, drift), path, single)


def thunderstorm(locs: DataFrame) -> DataFrame:
    """id, frame and positions to three decimals; z only if some z is not 0. Ids are 0 to n - 1, in order of loc_id."""
    has_z = locs.filter("z <> 0").limit(1).count() > 0
    columns = [F.col("k").alias('"id"'), F.col("frame").alias('"frame"'), three("x").alias('"x [nm]"'), three("y").alias('"y [nm]"')]
    return numbered(locs, ["loc_id"]).select(*columns, *([three("z").alias('"z [nm]"')] if has_z else []))


def write_thunderstorm(locs: DataFrame, path: str, single: bool = True) -> None:
    """Header names carry their quotes, as other programs expect them. Ids follow each other in the order of the files."""
    _write(thunderstorm(locs), path, single)


def molecule_set(locs: DataFrame, pixel_nm: float, photons: Column | None = None, ux: Column | None = None, uy: Column | None = None, uz: Column | None = None, flat: bool = False, swap_axes: bool = True) -> DataFrame:
    """The nine columns of a molecule set. x and y change places (``swap_axes``), z goes by the sideways pixel, and INDEX
    runs from 0 to n - 1 in order of loc_id.
    """
    f32 = lambda c: c.cast("float")
    x, y = ("y", "x") if swap_axes else ("x", "y")
    xy = F.sqrt(ux * ux + uy * uy) / pixel_nm if ux is not None and uy is not None else F.lit(0.1)
    return numbered(locs, ["loc_id"], "__index").select(
        f32(F.col(x) / pixel_nm).alias("X_POS_PIXELS"), f32(F.col(y) / pixel_nm).alias("Y_POS_PIXELS"),
        f32(F.lit(1.0) if flat else F.col("z") / pixel_nm).alias("Z_POS_PIXELS"), f32(xy).alias("PRECISION_XY_PIXELS"),
        f32(uz / pixel_nm if uz is not None else F.lit(0.1)).alias("PRECISION_Z_PIXELS"), f32(photons if photons is not None else F.lit(1000.0)).alias("PHOTONS"),
        F.lit(0).alias("CHANNEL"), F.col("frame").cast("int").alias("FRAME_NUMBER"), F.col("__index").alias("INDEX"),
    )


def write_molecule_set(locs: DataFrame, path: str, pixel_nm: float, pixel_z_nm: float | None = None, **options) -> None:
    """Tables ``datatable`` and ``meta``; reading them back gives the same positions only with ``swap_axes=False``."""
    molecule_set(locs, pixel_nm, **options).write.mode("overwrite").parquet(f"{path}/datatable")
    meta = locs.sparkSession.createDataFrame([(pixel_nm / 1e3, (pixel_z_nm or pixel_nm) / 1e3, 1)], "xy_pixel_size_um double, z_pixel_size_um double, flag_dcorr_applied int")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def drift_csv(drift: DataFrame) -> DataFrame:
    """frame, x_nm, y_nm, z_nm."""
    return drift.select(F.col("frame").cast("double").alias("frame"), F.col("dx").alias("x_nm"), F.col("dy").alias("y_nm"), F.col("dz").alias("z_nm"))


def write_drift_csv(drift: DataFrame, path: str, single: bool = True) -> None:
    _write(drift_csv(drift).orderBy("frame"), path, single)


def parameters(params: dict, spark) -> DataFrame:
    """key, value (as text), in order of the keys."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "key string, value string")


def write_details(result, path: str, truth: DataFrame | None = None) -> None:
    """Tables drift_segments, drift_frames, parameters and trace of a finished run, and the true drift where it is known."""
    if truth is not None:
        truth.write.mode("overwrite").parquet(f"{path}/drift_truth")
    result.drift_segments.write.mode("overwrite").parquet(f"{path}/drift_segments")
    result.drift_frames.write.mode("overwrite").parquet(f"{path}/drift_frames")
    parameters(result.params, result.drift_frames.sparkSession).write.mode("overwrite").parquet(f"{path}/parameters")
    result.trace.write.mode("overwrite").parquet(f"{path}/trace")


def write_intermediate(step: DataFrame, path: str) -> None:
    """One optimizer round (with its column ``iteration``), added to those before."""
    step.write.mode("append").partitionBy("iteration").parquet(path)


def write_custom(df: DataFrame, path: str, hint: str) -> None:
    """Any format that Spark can write."""
    df.write.mode("overwrite").format(hint).save(path)
