"""Each job as a query: run twice over the whole tables into a new folder, its output read back, and the same in SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import queries as Q
from plumbline.operators import drift as D
from plumbline.sources import sinks
from plumbline.sources.scratch import scratch

from . import intake, render
from .common import LOC, configured

_HERE = Path(__file__).resolve().parent


def _folder(spark: SparkSession, job: str) -> str:
    return f"{scratch(spark)}/{job}-{uuid.uuid4().hex}"


def _settings(kind, spark: SparkSession, name: str, **given):
    """The config file that comes with the job, which is in the repository and not where the data are."""
    import json

    return configured(kind, spark, None, json.loads((_HERE / name).read_text()) | given)


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the events: where it went, its segment, and the figures of its block."""
    cfg = _settings(intake.Intake, spark, "intake.json", input=f"{sf_dir}/events.parquet", output=_folder(spark, "intake"))
    intake.run(spark, cfg)
    intake.run(spark, cfg)
    locs, blocks, segments = (intake.read(spark, cfg, t) for t in ("locs", "blocks", "segments"))
    bounds = segments.select("segment", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"), F.col("n_locs").alias("segment_locs"))
    taken = locs.join(blocks, "block").join(bounds, "frame").select(*LOC, "block", "segment", "segment_locs", *(c for c in blocks.columns if c != "block"), F.lit("").alias("why"))
    # what a rejected row lacks is -1
    return taken.unionByName(intake.read(spark, cfg, "rejected").drop("batch"), allowMissingColumns=True).na.fill(-1)


def job2_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the images with the figures of its channel."""
    folder = _folder(spark, "render")
    frames = D.frame_axis_of(Q.locs(spark, sf_dir))
    # whole eighths of a nm, so that positions are the same numbers in every engine
    drift = frames.select("frame", (F.floor(F.col("frame") / 10) / 8.0).alias("dx"), (F.floor(F.col("frame") / 7) / -4.0).alias("dy"), F.lit(0.5).alias("dz"))
    sinks.write_drift_csv(drift, f"{folder}/drift.csv", single=False)
    cfg = _settings(render.Render, spark, "render.json", input=f"{sf_dir}/events.parquet", output=f"{folder}/out", drift=f"{folder}/drift.csv")
    render.run(spark, cfg)
    images = render.run(spark, cfg)
    return images.join(render.read(spark, cfg, "summary"), "channel")


QUERIES = {"job1_intake": job1_intake, "job2_render": job2_render}

_GOOD = Q._LOCS.replace("FROM events", "FROM events WHERE event_type <> 'error'")
_MEANS = ", ".join(f"sum(CAST(round({a} * 1000) AS BIGINT)) / 1000.0::DOUBLE / count(*) AS {a}_mean" for a in "xyz")
_BOX = ", ".join(f"min({a}) AS {a}_min, max({a}) AS {a}_max" for a in "xyz")
_FIGURES = "n_locs, x_min, y_min, z_min, x_max, y_max, z_max, x_mean, y_mean, z_mean, n_cells, fullest, n_pairs"
_NONE = ", ".join(f"{'-1.0::DOUBLE' if c[0] in 'xyz' else '-1'} AS {c}" for c in _FIGURES.split(", "))
ORACLES = {
    "job1_intake": f"""WITH RECURSIVE {Q._by_count(str(Q.LEAST)).replace(Q._LOCS, _GOOD)},
placed AS (SELECT *, CAST(frame // 50 AS INT) AS block FROM assign),
cells AS (SELECT block, count(*) AS n FROM placed GROUP BY block, floor(x / 40), floor(y / 40), floor(z / 40)),
dense AS (SELECT block, count(*) AS n_cells, max(n) AS fullest, CAST(sum(n * (n - 1)) AS BIGINT) AS n_pairs FROM cells GROUP BY block),
blocks AS (SELECT block, count(*) AS n_locs, {_BOX}, {_MEANS} FROM placed GROUP BY block),
sizes AS (SELECT segment, count(*) AS segment_locs FROM placed GROUP BY segment)
SELECT loc_id, x, y, z, frame, block, segment, segment_locs, {_FIGURES}, '' AS why FROM placed JOIN blocks USING (block) JOIN dense USING (block) JOIN sizes USING (segment)
UNION ALL SELECT event_id, value, user_id * 3.0::DOUBLE, -1.0::DOUBLE, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT), -1, -1, -1, {_NONE}, 'no z' FROM events WHERE event_type = 'error'""",
    "job2_render": f"""WITH {Q._LOCS}, e AS (SELECT l.*, event_type AS channel FROM locs l JOIN events ON event_id = loc_id),
p AS (SELECT channel, CAST(floor(x / 20) AS BIGINT) AS px, CAST(floor(y / 20) AS BIGINT) AS py, 1 AS b, 0 AS a FROM e
  UNION ALL SELECT channel, CAST(floor((x - floor(frame / 10.0::DOUBLE) / 8.0::DOUBLE) / 20) AS BIGINT), CAST(floor((y - floor(frame / 7.0::DOUBLE) / -4.0::DOUBLE) / 20) AS BIGINT), 0, 1 FROM e),
i AS (SELECT channel, px, py, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM p GROUP BY channel, px, py),
s AS (SELECT channel, CAST(sum(after) AS BIGINT) AS n_locs, count(*) AS n_pixels, CAST(sum(before * before) AS BIGINT) AS sharp_before, CAST(sum(after * after) AS BIGINT) AS sharp_after FROM i GROUP BY channel)
SELECT i.*, CAST(floor(px / 16.0::DOUBLE) AS BIGINT) AS tile_x, CAST(floor(py / 16.0::DOUBLE) AS BIGINT) AS tile_y, n_locs, n_pixels, sharp_before, sharp_after FROM i JOIN s USING (channel)""",
}
