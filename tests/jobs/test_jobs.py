"""Both jobs: their queries against SQL, growing input, reruns, failures half-way, and the command line."""

import json
import os
import shutil
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import intake, queries, render
from jobs.common import LOC, configured
from plumbline.operators import segment as S
from plumbline.sources import sinks, synthetic

ROOT = Path(__file__).resolve().parent.parent.parent


def table(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    mine, theirs = queries.QUERIES[name](spark, small).toPandas().sort_index(axis=1), con.sql(queries.ORACLES[name]).df().sort_index(axis=1)
    assert list(mine) == list(theirs)
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert mine.notna().all(axis=None) and rows(mine) == rows(theirs)


# ---- intake ------------------------------------------------------------------------------------------------------------
def arriving(spark, folder, rows):
    spark.createDataFrame(rows, "loc_id long, x double, y double, z double, frame int").coalesce(1).write.mode("append").parquet(str(folder))


def batch_of(k, n=120, frames=30):
    """Localizations of frames that overlap with those of the batch before."""
    return [(1000 * k + i, float(i % 37) * 3.5, float(i % 11), 0.25 * i, 20 * k + i % frames) for i in range(n)]


def test_only_new_files_are_taken_and_the_result_is_that_of_one_run(spark, tmp_path):
    cfg = intake.Intake(input=str(tmp_path / "in"), output=str(tmp_path / "out"), block_frames=10, least=50, cell_nm=20.0)
    arriving(spark, cfg.input, batch_of(0))
    intake.run(spark, cfg)
    first = files(cfg.output + "/locs")
    arriving(spark, cfg.input, [*batch_of(1), (9, None, 0.0, 0.0, 1), (10, 1.0, float("nan"), 0.0, 1), (11, 1.0, 1.0, 1.0, -1), (12, 1.0, 1.0, 1.0, None)])
    intake.run(spark, cfg)
    assert first.items() <= files(cfg.output + "/locs").items()  # what was there has not been written again
    assert intake.read(spark, cfg, "locs").select(F.max("batch")).first()[0] == 1
    assert sorted((r.loc_id, r.why) for r in intake.read(spark, cfg, "rejected").collect()) == [(9, "no x"), (10, "no y"), (11, "frame under 0"), (12, "no frame")]
    untouched = {f: t for f, t in files(cfg.output + "/blocks").items() if "block=0/" in f}
    arriving(spark, cfg.input, batch_of(2))
    intake.run(spark, cfg)
    assert untouched.items() <= files(cfg.output + "/blocks").items()  # frames 40 and later do not touch block 0
    whole = replace(cfg, output=str(tmp_path / "whole"))
    intake.run(spark, whole)
    for t in ("locs", "blocks", "frames", "segments", "rejected"):
        assert table(intake.read(spark, cfg, t).drop("batch")) == table(intake.read(spark, whole, t).drop("batch")), t


def test_a_run_without_new_files_changes_nothing(spark, tmp_path):
    cfg = intake.Intake(input=str(tmp_path / "in"), output=str(tmp_path / "out"), least=30)
    arriving(spark, cfg.input, batch_of(0))
    a = table(intake.run(spark, cfg))
    before = {t: (table(intake.read(spark, cfg, t)), files(f"{cfg.output}/{t}")) for t in ("locs", "blocks", "frames")}
    settings = spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert table(intake.run(spark, cfg)) == a
    assert before == {t: (table(intake.read(spark, cfg, t)), files(f"{cfg.output}/{t}")) for t in before}
    assert settings == (spark.sparkContext.getConf().getAll(), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_a_batch_that_failed_half_way_is_done_again(spark, tmp_path, monkeypatch):
    cfg = intake.Intake(input=str(tmp_path / "in"), output=str(tmp_path / "out"), block_frames=10)
    arriving(spark, cfg.input, batch_of(0))
    intake.run(spark, cfg)
    arriving(spark, cfg.input, batch_of(1))
    with monkeypatch.context() as m:
        m.setattr(intake, "summed", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            intake.run(spark, cfg)
    assert intake.read(spark, cfg, "locs").count() == 240  # written, but the blocks are not
    intake.run(spark, cfg)
    whole = replace(cfg, output=str(tmp_path / "whole"))
    intake.run(spark, whole)
    assert intake.read(spark, cfg, "locs").count() == 240
    for t in ("blocks", "frames", "segments"):
        assert table(intake.read(spark, cfg, t)) == table(intake.read(spark, whole, t)), t


def test_segments_are_those_of_the_library(spark, tmp_path):
    cfg = intake.Intake(input=str(tmp_path / "in"), output=str(tmp_path / "out"), least=40)
    arriving(spark, cfg.input, batch_of(0))
    intake.run(spark, cfg)
    want = S.by_count(intake.read(spark, cfg, "locs"), 40).segments
    got = intake.read(spark, cfg, "segments").filter("segment >= 0")
    assert table(got.select("segment", "start_frame", "end_frame", "n_locs")) == table(want.select("segment", "start_frame", "end_frame", "n_locs"))


def test_nothing_good_and_nothing_at_all(spark, tmp_path):
    cfg = intake.Intake(input=str(tmp_path / "in"), output=str(tmp_path / "out"))
    arriving(spark, cfg.input, [(1, None, None, None, None)])
    assert intake.run(spark, cfg).count() == 0 and intake.read(spark, cfg, "rejected").count() == 1 and intake.read(spark, cfg, "segments").count() == 0
    with pytest.raises(ValueError):
        intake.run(spark, intake.Intake())


# ---- render ------------------------------------------------------------------------------------------------------------
def measured(spark, folder, n=200):
    rows = [(k, float(k % 40) * 10 + k % 9 * 1.0, float(k % 2) * 10, 0.0, k % 9, ("red", "green", None)[k % 40 % 3]) for k in range(n)]
    spark.createDataFrame(rows, "loc_id long, x double, y double, z double, frame int, channel string").write.parquet(f"{folder}/in.parquet")
    drift = spark.createDataFrame([(f, 1.0 * f, 0.0, 0.0) for f in range(9)], "frame int, dx double, dy double, dz double")
    sinks.write_drift_csv(drift, f"{folder}/drift.csv")
    return rows


def test_images_equal_a_plain_count_and_runs_repeat(spark, tmp_path):
    rows = measured(spark, tmp_path)
    cfg = render.Render(input=f"{tmp_path}/in.parquet", output=f"{tmp_path}/out", drift=f"{tmp_path}/drift.csv", pixel_nm=5.0, tile_px=8)
    want = {}
    for _, x, y, _, f, c in rows:
        for k, at in enumerate((x, x - f)):
            want.setdefault((c, at // 5, y // 5), [0, 0])[k] += 1
    for _ in range(2):
        got = {(r.channel, r.px, r.py): [r.before, r.after] for r in render.run(spark, cfg).collect()}
        assert got == want
        assert render.read(spark, cfg, "corrected").count() == 200
    sharp = {r.channel: (r.sharp_after, r.sharp_before) for r in render.read(spark, cfg, "summary").collect()}
    assert sharp == {c: tuple(sum(v[k] ** 2 for w, v in want.items() if w[0] == c) for k in (1, 0)) for c in ("red", "green", None)}
    assert all(a > b for a, b in sharp.values())


def test_a_run_of_some_channels_leaves_the_others(spark, tmp_path):
    measured(spark, tmp_path)
    cfg = render.Render(input=f"{tmp_path}/in.parquet", output=f"{tmp_path}/out", drift=f"{tmp_path}/drift.csv", pixel_nm=5.0)
    before = table(render.run(spark, cfg))
    green = {f: t for f, t in files(f"{tmp_path}/out").items() if "channel=green" in f}
    still = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in range(9)], "frame int, dx double, dy double, dz double")
    sinks.write_drift_csv(still, f"{tmp_path}/none.csv")
    again = render.run(spark, replace(cfg, channels=("red",), drift=f"{tmp_path}/none.csv"))
    assert green and green.items() <= files(f"{tmp_path}/out").items()
    assert again.filter("channel = 'red' AND before <> after").count() == 0 and again.filter("channel = 'green' AND before <> after").count() > 0
    assert table(render.run(spark, cfg)) == before


def test_a_frame_without_drift_is_an_error(spark, tmp_path):
    measured(spark, tmp_path)
    sinks.write_drift_csv(spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame int, dx double, dy double, dz double"), f"{tmp_path}/short.csv")
    with pytest.raises(Exception, match="no drift for frame"):
        render.run(spark, render.Render(input=f"{tmp_path}/in.parquet", output=f"{tmp_path}/out", drift=f"{tmp_path}/short.csv"))


def test_drift_is_estimated_without_a_table(spark, tmp_path):
    """Two channels of the same sites get one drift, and both get sharper."""
    locs = synthetic.sites_in_cube(spark, 100, 40, 60).withColumn("channel", F.when(F.col("loc_id") % 2 == 0, "a").otherwise("b"))
    locs.write.parquet(f"{tmp_path}/in.parquet")
    cfg = render.Render(input=f"{tmp_path}/in.parquet", output=f"{tmp_path}/out", pixel_nm=10.0, estimate={"segmentation_var": 2, "initial_sigma_nm": 60, "max_drift_nm": 100, "target_sigma_nm": 10})
    render.run(spark, cfg)
    assert {r.channel: r.sharp_after > 1.1 * r.sharp_before for r in render.read(spark, cfg, "summary").collect()} == {"a": True, "b": True}


# ---- both --------------------------------------------------------------------------------------------------------------
def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"least": 7, "input": "there"}))
    cfg = configured(intake.Intake, spark, str(tmp_path / "c.json"), {"input": "here", "output": None})
    assert (cfg.least, cfg.input, cfg.output) == (7, "here", "")
    (tmp_path / "d.json").write_text(json.dumps({"colour": 7}))
    with pytest.raises(KeyError, match="colour"):
        configured(intake.Intake, spark, str(tmp_path / "d.json"), {})


@pytest.mark.parametrize("job", ["intake", "render"])
def test_command_line(small, tmp_path, job):
    """As a program of its own, twice, on a copy of the given table."""
    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
    (tmp_path / "drift.csv").write_text("frame,x_nm,y_nm,z_nm\n" + "".join(f"{f},0.5,0.25,0\n" for f in range(800)))
    drift = ["--drift", f"{tmp_path}/drift.csv"] if job == "render" else []
    command = [sys.executable, "-m", f"jobs.{job}", "--config", f"{ROOT}/jobs/{job}.json", "--input", f"{tmp_path}/events.parquet", "--output", f"{tmp_path}/out", *drift]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    counts = []
    for _ in range(2):
        done = subprocess.run(command, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "rows_read" in done.stderr and "output" in done.stderr
        counts.append(duckdb.sql(f"SELECT count(*) FROM read_parquet('{tmp_path}/out/{'locs' if job == 'intake' else 'corrected'}/**/*.parquet')").fetchall()[0])
    assert counts[0] == counts[1] and counts[0][0] > 0
