"""Sources of localization tables: CSV with ThunderSTORM headers, molecule sets, simulations. Coordinates come out in nm.

HDF5 needs a library that is not at hand; molecule sets and simulations are read from tables of the same logical schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of the CSV columns.
FRAME, CSV_AXES = "frame", ("x [nm]", "y [nm]", "z [nm]")


def _csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    try:
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    except Exception as e:
        raise FileNotFoundError(f"{path} can't be read: {e}") from e


def read_csv_all(spark: SparkSession, path: str) -> DataFrame:
    """All columns, with types inferred."""
    try:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    except Exception as e:
        raise FileNotFoundError(f"{path} can't be read: {e}") from e


def read_thunderstorm(spark: SparkSession, path: str) -> DataFrame:
    """loc_id, x, y, z, frame of a CSV; z is 0 where the column is missing. Only those columns are parsed.

    loc_id is the column ``id`` if there is one, else a number of the row (not consecutive).
    """
    return essentials(_csv(spark, path))


def essentials(df: DataFrame) -> DataFrame:
    """The localization columns of a table with ThunderSTORM headers."""
    if missing := [c for c in (FRAME, *CSV_AXES[:2]) if c not in df.columns]:
        raise KeyError(f"no column {missing[0]!r}")
    number = F.col("id").cast("long") if "id" in df.columns else F.monotonically_increasing_id()  # the pair search numbers rows for itself
    z = F.col(f"`{CSV_AXES[2]}`").cast("double") if CSV_AXES[2] in df.columns else F.lit(0.0)
    return df.select(number.alias("loc_id"), *(F.col(f"`{c}`").cast("double").alias(c[0]) for c in CSV_AXES[:2]), z.alias("z"), F.col(FRAME).cast("double").cast("int").alias("frame"))


def pixel_sizes(meta: dict) -> tuple[float, float]:
    """nm per pixel, sideways and in depth; the first of the known keys decides."""
    for keys in (("pixel_size_um", "pixel_size_um"), ("xy_pixel_size_um", "z_pixel_size_um"), ("pixelsize_um", "pixelsize_um")):
        if all(meta.get(k) is not None for k in keys):
            return meta[keys[0]] * 1e3, meta[keys[1]] * 1e3
    raise KeyError("no pixel size: pixel_size_um, xy_pixel_size_um with z_pixel_size_um, or pixelsize_um")


def bandpass(df: DataFrame, photons: tuple[float | None, float | None], column: str = "PHOTONS") -> DataFrame:
    """Rows strictly between the bounds; only if both are given."""
    lo, hi = photons
    return df if lo is None or hi is None else df.filter((F.col(column) > lo) & (F.col(column) < hi))


def molecule_set(table: DataFrame, meta: dict, photons: tuple[float | None, float | None] = (None, None), loc_id: Column | None = None) -> DataFrame:
    """Localizations of a molecule-set table (X_POS_PIXELS ... FRAME_NUMBER): pixels to nm; z is 0 without its column."""
    xy, depth = pixel_sizes(meta)
    number = loc_id if loc_id is not None else F.col("INDEX").cast("long") if "INDEX" in table.columns else F.monotonically_increasing_id()
    z = F.col("Z_POS_PIXELS").cast("double") * depth if "Z_POS_PIXELS" in table.columns else F.lit(0.0)
    return bandpass(table, photons).select(number.alias("loc_id"), (F.col("X_POS_PIXELS").cast("double") * xy).alias("x"), (F.col("Y_POS_PIXELS").cast("double") * xy).alias("y"), z.alias("z"), F.col("FRAME_NUMBER").cast("int").alias("frame"))


def read_molecule_set(spark: SparkSession, path: str, photons: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """A folder with Parquet tables ``datatable`` and ``meta`` (one row)."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    return molecule_set(spark.read.parquet(f"{path}/datatable"), meta, photons)


def transposed_drift(matrix: DataFrame) -> DataFrame:
    """A 3 x T matrix (one row of arrays x, y, z in um) as rows frame, dx, dy, dz in nm."""
    zipped = matrix.select(F.posexplode(F.arrays_zip("x", "y", "z")).alias("frame", "v"))
    return zipped.select("frame", *((F.col(f"v.{a}") * 1e3).alias(f"d{a}") for a in "xyz"))


def simulation(locs_um: DataFrame) -> DataFrame:
    """Localizations as simulated: um to nm."""
    return locs_um.select("loc_id", *((F.col(f"{a}_um") * 1e3).alias(a) for a in "xyz"), F.col("frame_number").cast("int").alias("frame"))


def ideal_positions(locs: DataFrame, sites: DataFrame, drift: DataFrame) -> DataFrame:
    """Positions without localization error: that of the label site, plus the drift of the frame. In nm throughout."""
    at = locs.select("loc_id", F.col("label_site_index").alias("site_id"), F.col("frame_number").cast("int").alias("frame"))
    both = at.join(sites.select("site_id", "x", "y", "z"), "site_id").join(drift.select("frame", "dx", "dy", "dz"), "frame")
    return both.select("loc_id", *((F.col(a) + F.col(f"d{a}")).alias(a) for a in "xyz"), "frame")


def read(spark: SparkSession, path: str) -> DataFrame:
    """By ending: .csv, or .parquet for a molecule set's folder; anything else is a ValueError.

    .h5 files need a library that Spark does not have: they are refused with the way out.
    """
    if path.endswith(".csv"):
        return read_thunderstorm(spark, path)
    if path.endswith(".parquet"):
        return read_molecule_set(spark, path)
    if path.endswith(".h5"):
        raise ValueError(f"{path}: HDF5 can't be read here; write its datatable and meta as Parquet to a folder named *.parquet")
    raise ValueError(f"{path}: neither .csv nor .parquet")
