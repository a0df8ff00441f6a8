"""Intake of an acquisition that is still going on: python -m jobs.intake --config jobs/intake.json --input ... --output ...

A microscope writes localization files as it goes along. Each run takes the files that no run has taken before (the
checkpoint of a file stream knows which), sorts out rows without a place, adds the others to the table of localizations,
and brings up to date what the operator wants to know while there is still time to change something:

    locs/       localizations, by block of frames and by the run's batch
    rejected/   rows without a position or with a frame under 0, and why, by batch
    frames/     localizations per frame, by block
    blocks/     of each block of frames: localizations, frames, bounding box, center of mass, occupied cells, the fullest
                cell, and the pairs of one cell (twice), by which one judges whether max_drift_nm can be afforded
    segments/   the segments of at least ``least`` localizations that are closed so far, and the open tail (-1)

A batch writes its own partitions only, and the blocks that it touches anew from the localizations; all are overwritten
dynamically. A batch that failed half-way is done again by the next run, with the same files and the same result; a run
that finds nothing new changes nothing. Sums are taken over whole thousandths of a nm, so that they do not depend on the
order of rows. A file that is replaced under its old name is not taken again.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import segment as S

from .common import LOC, as_locs, begin, configured, logged


@dataclass(frozen=True)
class Intake:
    input: str = ""
    output: str = ""
    #: Where the stream keeps what it has taken; by default in the output folder.
    checkpoint: str = ""
    #: SQL expressions of the input's columns.
    columns: dict[str, str] = field(default_factory=lambda: {c: c for c in LOC})
    #: Frames of a block, localizations of a segment, and the side of a cell in nm.
    block_frames: int = 50
    least: int = 200
    cell_nm: float = 100.0
    #: Files that a batch takes at most; 0 for all at once.
    files_at_once: int = 0


def judged(locs: DataFrame) -> DataFrame:
    """The rows with ``why``: what is wrong with them, or null."""
    wrong = [F.when(F.col(c).isNull() | F.isnan(c), f"no {c}") for c in "xyz"]
    return locs.withColumn("why", F.coalesce(*wrong, F.when(F.col("frame").isNull(), "no frame"), F.when(F.col("frame") < 0, "frame under 0")))


def summed(locs: DataFrame, cell_nm: float) -> DataFrame:
    """A row per block. Rows of a cell are folded before blocks are, so that a hot block is many partial sums."""
    cell = [F.floor(F.col(a) / cell_nm).alias(f"c{a}") for a in "xyz"]
    whole = lambda a: F.round(F.col(a) * 1000).cast("long")
    first = locs.groupBy("block", *cell).agg(
        F.count("*").alias("n"), *(F.sum(whole(a)).alias(f"s{a}") for a in "xyz"), *(F.min(a).alias(f"{a}_min") for a in "xyz"), *(F.max(a).alias(f"{a}_max") for a in "xyz")
    )
    return first.groupBy("block").agg(
        F.sum("n").alias("n_locs"), *(F.min(f"{a}_min").alias(f"{a}_min") for a in "xyz"), *(F.max(f"{a}_max").alias(f"{a}_max") for a in "xyz"),
        *((F.sum(f"s{a}") / F.lit(1000.0) / F.sum("n")).alias(f"{a}_mean") for a in "xyz"),
        F.count("*").alias("n_cells"), F.max("n").alias("fullest"), F.sum(F.col("n") * (F.col("n") - 1)).alias("n_pairs"),
    )


def _put(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that the rows fall into, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _take(cfg: Intake):
    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        found = judged(rows).withColumn("batch", F.lit(batch).cast("long")).withColumn("block", F.floor(F.col("frame") / cfg.block_frames).cast("int"))
        good = found.filter("why IS NULL").drop("why")
        _put(good.repartition("block"), f"{cfg.output}/locs", "block", "batch")
        _put(found.filter("why IS NOT NULL").drop("block"), f"{cfg.output}/rejected", "batch")
        locs = read(spark, cfg, "locs")
        mine = locs.filter(F.col("batch") == batch)
        touched = mine.select("block").distinct()  # of a batch: as many rows as it has folders
        stale = locs.join(touched, "block", "left_semi")
        counts = S.frame_counts(stale).withColumn("block", F.floor(F.col("frame") / cfg.block_frames).cast("int"))
        _put(counts, f"{cfg.output}/frames", "block")
        _put(summed(stale, cfg.cell_nm), f"{cfg.output}/blocks", "block")
        bad = read(spark, cfg, "rejected").filter(F.col("batch") == batch).count()
        logged("intake, batch", number=batch, taken=mine.count(), rejected=bad, blocks=touched.count())

    return take


def run(spark: SparkSession, cfg: Intake) -> DataFrame:
    """Takes what is new and returns the table of blocks."""
    if not cfg.input or not cfg.output:
        raise ValueError("intake needs an input and an output")
    schema = spark.read.parquet(cfg.input).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", cfg.files_at_once) if cfg.files_at_once else reader
    # as a pattern, since a stream takes a path without one for a folder, and the input may be a single file
    path = cfg.input.rstrip("/")
    new = as_locs(reader.parquet(f"{path[:-1]}[{path[-1]}]"), cfg.columns)
    stream = new.writeStream.foreachBatch(_take(cfg)).option("checkpointLocation", cfg.checkpoint or f"{cfg.output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    took = sum(p["numInputRows"] for p in stream.recentProgress)
    logged("intake", input=cfg.input, rows_read=took)
    closed(spark, cfg)  # also if nothing is new: a run may have ended between a batch and this
    blocks = read(spark, cfg, "blocks")
    logged("intake", output=cfg.output, blocks=blocks.count())
    return blocks


_LOCS = ", ".join(f"{c} {k}" for c, k in LOC.items())
_BOX = ", ".join(f"{a}_{m} double" for m in ("min", "max", "mean") for a in "xyz")
TABLES = {
    "locs": f"{_LOCS}, block int, batch long", "rejected": f"{_LOCS}, why string, batch long", "frames": "frame int, n long, block int",
    "blocks": f"n_locs long, {_BOX}, n_cells long, fullest long, n_pairs long, block int", "segments": "segment int, start_frame int, end_frame int, n_frames long, n_locs long",
}


def read(spark: SparkSession, cfg: Intake, table: str) -> DataFrame:
    """A table of the output; one that has not been written has no rows."""
    try:
        return spark.read.schema(TABLES[table]).parquet(f"{cfg.output}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[table])


def closed(spark: SparkSession, cfg: Intake) -> None:
    """The segments so far, from the table of frames alone (a row per frame)."""
    frames = read(spark, cfg, "frames").select("frame", "n")
    both = S.closes(frames, cfg.least).join(frames, "frame")
    out = both.groupBy("segment").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_frames"), F.sum("n").alias("n_locs"))
    out.write.mode("overwrite").parquet(f"{cfg.output}/segments")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.intake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="settings as JSON")
    p.add_argument("--input", help="a folder of Parquet files that grows")
    p.add_argument("--output", help="the folder of the tables")
    p.add_argument("--checkpoint")
    a = p.parse_args(argv)
    began = begin()
    spark = SparkSession.builder.appName("intake").getOrCreate()
    try:
        run(spark, configured(Intake, spark, a.config, {k: v for k, v in vars(a).items() if k != "config"}))
        logged("intake", seconds=round(time.monotonic() - began, 1))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
