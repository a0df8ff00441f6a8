"""The drift queries by name, over projections of the star-schema tables, with the SQL that gives the same rows.

F1: ``events`` as localizations. F2: ``lineitem`` as a molecule set. F3: ``lineitem`` and ``part`` as a simulation with
label sites. F4: a drift of the segments in closed form. Floating sums are rounded, as their order is free.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cost as C
from .operators import drift as D
from .operators import kdpairs as K
from .operators import metrics as M
from .operators import pairs as P
from .operators import segment as S
from .operators import smooth as W
from .plans.estimate import estimate_drift, interpolate, refine_in_time
from .schema import DRIFT, DriftConfig
from .self_test import WITHIN_NM, recovered
from .sources import readers, sinks, synthetic
from .sources.scratch import scratch

R, SIGMA, WINDOW, LEAST, CAP, SEED = 20.0, 6.0, 50, 200, 100, 7


# ---- fixtures ----------------------------------------------------------------------------------------------------------
def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def locs(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("int")
    k = F.get_json_object("props", "$.k").cast("double")
    return _table(spark, sf, "events").select(F.col("event_id").alias("loc_id"), F.col("value").alias("x"), (F.col("user_id") * F.lit(3.0)).alias("y"), (k * 4.0).alias("z"), hour.alias("frame"))


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """F2."""
    days = F.expr("datediff(l_shipdate, DATE'1995-01-02')").cast("int")
    d = lambda c: F.col(c).cast("double")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("INDEX")
    return _table(spark, sf, "lineitem").select(d("l_partkey").alias("X_POS_PIXELS"), d("l_suppkey").alias("Y_POS_PIXELS"), d("l_linenumber").alias("Z_POS_PIXELS"), F.col("l_extendedprice").alias("PHOTONS"), days.alias("FRAME_NUMBER"), number)


def closed_drift(of: DataFrame, column: str = "segment") -> DataFrame:
    """(sin s, cos s / 2, s / 10) of every segment."""
    s = F.col(column).cast("double")
    return of.select(column, F.sin(s).alias("dx"), (F.cos(s) * 0.5).alias("dy"), (s * 0.1).alias("dz"))


def windows(spark, sf):
    return S.by_frame_windows(locs(spark, sf), WINDOW)


def centers(spark, sf) -> DataFrame:
    """F5."""
    s = F.col("segment").cast("double")
    return windows(spark, sf).segments.select("segment", "center_frame", F.sin(s).alias("dx"), (F.cos(s) * 0.5).alias("dy"), (s * 0.1).alias("dz"))


def frame_drift(spark, sf) -> DataFrame:
    """A drift for every frame of F1, in closed form."""
    f = F.col("frame").cast("double")
    return D.frame_axis_of(locs(spark, sf)).select("frame", (f * 0.01).alias("dx"), (f * -0.005).alias("dy"), F.lit(0.0).alias("dz"))


def other_drift(spark, sf) -> DataFrame:
    f = F.col("frame").cast("double")
    return D.frame_axis_of(locs(spark, sf)).select("frame", (f * 0.011).alias("dx"), F.sin(f / 50.0).alias("dy"), F.lit(1.0).alias("dz"))


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _pairs(spark, sf) -> DataFrame:
    return P.within_radius(windows(spark, sf).assign, R, ("segment",), unique=True)  # F1 is keyed by event_id


def _mu(spark, sf) -> DataFrame:
    return closed_drift(windows(spark, sf).segments)


def _folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}.csv"


def observed_sites(spark: SparkSession, sf: str) -> DataFrame:
    """every user is a site on a grid of 400 nm, seen in the hours of its events, with an error of some nanometres
    and the drift of ``slow_drift``.
    """
    u, f = F.col("user_id"), F.col("frame").cast("double")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("int")
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("loc_id"), hour.alias("frame"), "user_id", (F.pmod(F.floor("value"), F.lit(5)) - 2).alias("ex"), (F.pmod(F.col("event_id"), F.lit(5)) - 2).alias("ey"))
    at = {"x": F.pmod(u, F.lit(17)) * 400.0 + F.col("ex") + 40 * F.sin(f / 180), "y": F.pmod(F.floor(u / 17), F.lit(17)) * 400.0 + F.col("ey") + 0.06 * f, "z": F.floor(u / 289) * 400.0 + 25 * F.cos(f / 150)}
    return rows.select("loc_id", *(c.alias(a) for a, c in at.items()), "frame")


def slow_drift(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("frame").cast("double")
    return D.frame_axis_of(locs(spark, sf)).select("frame", (40 * F.sin(f / 180)).alias("dx"), (0.06 * f).alias("dy"), (25 * F.cos(f / 150)).alias("dz"))


def _smoothed(spark, sf):
    return centers(spark, sf)


def _sites(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"), F.lit(0.0).alias("z"))


# ---- queries -----------------------------------------------------------------------------------------------------------
def _simulated(spark, sf):
    m = molecules(spark, sf)
    return m.select(F.col("INDEX").alias("loc_id"), F.col("X_POS_PIXELS").cast("long").alias("label_site_index"), F.col("FRAME_NUMBER").alias("frame_number"), *((F.col(f"{a.upper()}_POS_PIXELS") / 1000.0).alias(f"{a}_um") for a in "xyz"))


def sim_ideal_positions(spark, sf):
    m = _simulated(spark, sf)
    f = F.col("frame").cast("double")
    drift = m.select(F.col("frame_number").alias("frame")).distinct().select("frame", (f * 0.01).alias("dx"), (f * -0.005).alias("dy"), F.lit(0.0).alias("dz"))
    return _round(readers.ideal_positions(m, _sites(spark, sf), drift), "x", "y", "z")


def sim_drift_frames(spark, sf):
    matrix = _table(spark, sf, "region").agg(*(F.transform(F.sort_array(F.collect_list("r_regionkey")), f).alias(a) for a, f in (("x", lambda k: k * 0.001), ("y", lambda k: k * -0.002), ("z", lambda k: k * 0.0))))
    return _round(readers.transposed_drift(matrix).withColumn("frame", F.col("frame").cast("int")), "dx", "dy", "dz")


def csv_scan(spark, sf):
    """F1 as a CSV file without z, written and scanned."""
    path = _folder(spark)
    locs(spark, sf).select(F.col("loc_id").alias("id"), "frame", F.col("x").alias("x [nm]"), F.col("y").alias("y [nm]"), F.lit("x").alias("note")).write.option("header", True).csv(path)
    return readers.read(spark, path)


def corrected_csv(spark, sf):
    t = locs(spark, sf).select(F.col("loc_id").alias("id"), "frame", F.col("x").alias("x [nm]"), F.col("y").alias("y [nm]"), F.col("z").alias("z [nm]"), (F.col("x") * 2).alias("intensity"))
    # multiples of 1/8, so that three decimals hold every value
    flat = frame_drift(spark, sf).select("frame", (F.floor(F.col("frame") / 10) / 8.0).alias("dx"), F.lit(0.5).alias("dy"), F.lit(-0.25).alias("dz"))
    path = _folder(spark)
    sinks.write_corrected_csv(t, flat, path, single=False)
    back = readers._csv(spark, path)
    return back.select(F.col("id").cast("long"), F.col("frame").cast("int"), *(F.col(f"`{c}`") for c in back.columns[2:]))


def thunderstorm_export(spark, sf):
    path = _folder(spark)
    sinks.write_thunderstorm(locs(spark, sf), path, single=False)
    out = readers._csv(spark, path).toDF("id", "frame", "x_nm", "y_nm", "z_nm")
    return out.withColumns({"id": F.col("id").cast("long"), "frame": F.col("frame").cast("int")})


def molecule_set_export(spark, sf):
    l = locs(spark, sf)
    return _round(sinks.molecule_set(l, 160.0, ux=F.lit(3.0), uy=F.lit(4.0)).withColumns({c: F.col(c).cast("double") for c in ("X_POS_PIXELS", "Y_POS_PIXELS", "Z_POS_PIXELS", "PRECISION_XY_PIXELS", "PRECISION_Z_PIXELS", "PHOTONS")}), "X_POS_PIXELS", "Y_POS_PIXELS", "Z_POS_PIXELS", "PRECISION_XY_PIXELS", "PRECISION_Z_PIXELS", digits=4)


def drift_csv(spark, sf):
    path = _folder(spark)
    sinks.write_drift_csv(frame_drift(spark, sf), path, single=False)
    return readers._csv(spark, path, "frame double, x_nm double, y_nm double, z_nm double")


def synthetic_template(spark, sf):
    sites = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("site_id"), (F.col("n_nationkey") * 5000.0).alias("x"), (F.col("n_regionkey") * 5000.0).alias("y"))
    return _round(synthetic.template(spark, sites, 20), "x", "y")


def seg_stats(spark, sf):
    s = windows(spark, sf)
    return _round(s.segments, "center_frame")


def seg_params(spark, sf):
    return S.statistics(S.by_frame_windows(locs(spark, sf), WINDOW, CAP))


def seg_num_windows(spark, sf):
    return _round(S.by_windows(locs(spark, sf), 12).segments, "center_frame")


def seg_cap(spark, sf):
    return S.by_frame_windows(locs(spark, sf), WINDOW, CAP, ["loc_id"]).assign.select("loc_id", "segment", "valid")


def seg_cap_seeded(spark, sf):
    """The reproducible random choice."""
    return S.by_frame_windows(locs(spark, sf), WINDOW, CAP, seed=SEED).assign.select("loc_id", "segment", "valid")


def seg_coarsen(spark, sf):
    return _round(S.coarsened(windows(spark, sf).segments, 4, 15), "center_frame")


def relabel_valid(spark, sf):
    return S.relabelled(S.by_frame_windows(locs(spark, sf), WINDOW, CAP, ["loc_id"]))


def seg_cap_choice(spark, sf):
    l = locs(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [S.cap_for(l, m, v, 0.5).select(F.lit(m).alias("mode"), "max_locs_per_segment") for m, v in ((0, 12), (1, LEAST), (2, WINDOW))])


def pairs_radius(spark, sf):
    p = P.within_radius(locs(spark, sf), R, unique=True)
    return _round(p, "dx0", "dy0", "dz0")


def pairs_radius_count(spark, sf):
    return P.within_radius(locs(spark, sf), R, unique=True).agg(F.count("*").alias("n_pairs"))


def pairs_kd(spark, sf):
    """The pairs within the radius by leaves of a k-d partition, about 32 of them."""
    l = locs(spark, sf)
    return _round(K.within_radius_kd(l, R, leaf_rows=max(64, l.count() // 32)), "dx0", "dy0", "dz0")


def pairs_expected(spark, sf):
    """Candidates by counts of cells, and whether the number of pairs that a sample tells is within a tenth of theirs."""
    guess = P.expected(locs(spark, sf), R)
    both = guess.crossJoin(pairs_radius_count(spark, sf).withColumnRenamed("n_pairs", "n"))  # one row each
    return both.select("n_candidates", (F.abs(F.col("n_pairs") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


def pairs_radius_flat(spark, sf):
    flat = locs(spark, sf).withColumn("z", F.lit(0.0))
    return P.within_radius(flat, 5.0, flat=True, unique=True).agg(F.count("*").alias("n_pairs"))


def pairs_binned(spark, sf):
    pairs = P.within_cells(locs(spark, sf), R)
    return pairs.agg(F.count("*").alias("n_pairs"), F.sum(F.col("loc_i") + 3 * F.col("loc_j")).alias("checksum"))


def pairs_all(spark, sf):
    return P.every_pair(_table(spark, sf, "nation").select(F.col("n_nationkey").alias("loc_id")))


def histogram(spark, sf):
    return P.histogram(locs(spark, sf), 40.0, 64).select("cx", "cy", "cz", "first", "n", F.array_join(F.col("loc_ids").cast("array<string>"), ",").alias("loc_ids"))


def cost_by_segment_pair(spark, sf):
    return _round(C.by_segment_pair(_pairs(spark, sf), _mu(spark, sf), C.gaussian(SIGMA)), "w", "mx", "my", "mz")


def cost_gradient(spark, sf):
    return _round(C.gradient(_pairs(spark, sf), _mu(spark, sf), C.gaussian(SIGMA)), "gx", "gy", "gz")


def cost_value(spark, sf):
    return _round(C.cost(_pairs(spark, sf), _mu(spark, sf), C.gaussian(SIGMA)), "cost", digits=4)


def cost_2d(spark, sf):
    return _round(C.cost(_pairs(spark, sf), _mu(spark, sf), C.plain(100.0, 2)), "cost", digits=4)


def cost_gradient_2d(spark, sf):
    return _round(C.gradient(_pairs(spark, sf), _mu(spark, sf), C.plain(100.0, 2)), "gx", "gy")


def cost_3d(spark, sf):
    return _round(C.cost(_pairs(spark, sf), _mu(spark, sf), C.plain(100.0)), "cost", digits=4)


def cost_gradient_3d(spark, sf):
    return _round(C.gradient(_pairs(spark, sf), _mu(spark, sf), C.plain(100.0)), "gx", "gy", "gz")


def boxcar_reflect(spark, sf):
    return _round(W.boxcar_reflect(_smoothed(spark, sf), 4), *DRIFT)


def boxcar_edge(spark, sf):
    return _round(W.boxcar_edge(_smoothed(spark, sf), 5), *DRIFT)


def interp_catmull_rom(spark, sf):
    return _round(D.catmull_rom(D.frame_axis_of(locs(spark, sf)), centers(spark, sf)), *DRIFT)


def interp_linear(spark, sf):
    return _round(D.linear(D.frame_axis_of(locs(spark, sf)), centers(spark, sf)), *DRIFT)


def interp_step(spark, sf):
    s = windows(spark, sf)
    return _round(D.step(S.frames_of_segments(s.segments), closed_drift(s.segments)), *DRIFT)


def interp_cubic(spark, sf):
    """Knots at the segments' centers, on a cubic, which not-a-knot splines give back."""
    at = centers(spark, sf).orderBy("segment").toArrow().column("center_frame").to_numpy()  # a row per segment
    t = at / 100.0
    mu = list(zip(t**3 - 4 * t * t, 2 * t * t - t, 3 - t, strict=True))
    return _round(interpolate(D.frame_axis_of(locs(spark, sf)), at, mu, "cubic"), *DRIFT, digits=4)


def interp_natural(spark, sf):
    """Three knots, at the frames that are one, two and three quarters of the last: the natural spline through 0, h, 0
    has a closed form, with straight ends.
    """
    last = locs(spark, sf).agg(F.max("frame")).first()[0]
    q = last / 4.0
    return _round(interpolate(D.frame_axis_of(locs(spark, sf)), [q, 2 * q, 3 * q], [(0.0, 0.0, 1.0), (3.0, -7.0, 1.0), (0.0, 0.0, 1.0)], "natural"), *DRIFT, digits=4)


def apply_drift(spark, sf):
    return _round(D.apply(locs(spark, sf), frame_drift(spark, sf)), "x", "y", "z")


def drift_center(spark, sf):
    return _round(D.centered(frame_drift(spark, sf)), *DRIFT)


def _compared(measure, name: str, on: str = "frame"):
    def query(spark, sf):
        return _round(measure(frame_drift(spark, sf), other_drift(spark, sf), on), name)

    return query


def drift_range_ok(spark, sf):
    out = M.range_ok(frame_drift(spark, sf), 5.0, 0.5)
    return _round(out, "dx_range", "dy_range", "dz_range")


def stride_subsample(spark, sf):
    """Every tenth localization, as for display."""
    return locs(spark, sf).filter(F.col("loc_id") % 10 == 0)


_RECOVERY = DriftConfig(2, 24, None, 120, 100, 10)


def _recovered(spark, sf, cfg=_RECOVERY):
    return estimate_drift(observed_sites(spark, sf), cfg)


def _recovery(cfg: DriftConfig):
    """Whether the drift put into all events comes back within a nanometre."""

    def query(spark, sf):
        whole = observed_sites(spark, sf).agg(F.count("*").alias("n_locs"), F.max("frame").alias("last_frame"))
        error = M.error(_recovered(spark, sf, cfg).drift_frames, slow_drift(spark, sf)).select((F.col("error") < WITHIN_NM).alias("ok"))
        return whole.crossJoin(error)  # one row each

    return query


def drift_recovery_frames(spark, sf):
    """Of every frame, whether its drift (less the mean) is within 5 nm of the one put in."""
    side = lambda df, s: D.centered(df).select("frame", *(F.col(c).alias(f"{c}_{s}") for c in DRIFT))
    both = side(_recovered(spark, sf).drift_frames, "a").join(side(slow_drift(spark, sf), "b"), "frame")
    return both.select("frame", reduce(lambda p, q: p & q, [F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) < 5.0 for c in DRIFT]).alias("near"))


def self_test(spark, sf):
    """The self-test at its own size: 60,000 localizations of 500 frames."""
    result, truth = recovered(spark)
    return M.error(result.drift_frames, truth).select((F.col("error") < WITHIN_NM).alias("ok"))


def optimizer_trace(spark, sf):
    return _recovered(spark, sf).trace


def drift_frames(spark, sf):
    return _recovered(spark, sf).drift_frames


def corrected_locs(spark, sf):
    return _recovered(spark, sf).corrected


def drift_refined(spark, sf):
    return refine_in_time(observed_sites(spark, sf), DriftConfig(2, 24, None, None, 100, 10)).drift_segments


def drift_blinking(spark, sf):
    """The whole run on molecules that blink under a linear drift, with the rms criterion and linear interpolation."""
    cfg = DriftConfig(1, 40, None, 0.3, 1.0, 0.05, criterion="rms", interpolation_method="linear")
    return estimate_drift(synthetic.blinking(spark), cfg).drift_frames


def refined_recovery(spark, sf):
    """Whether refinement in time brings the drift back as well."""
    found = refine_in_time(observed_sites(spark, sf), DriftConfig(2, 24, None, None, 100, 10)).drift_frames
    return M.error(found, slow_drift(spark, sf)).select((F.col("error") < 2 * WITHIN_NM).alias("ok"))


def blinking_recovery(spark, sf):
    """Whether the linear drift of the blinking molecules comes back within half of their error of 0.05."""
    f = F.col("frame") / 100.0 * 0.05
    truth = drift_blinking(spark, sf).select("frame", (f * 2).alias("dx"), (f * 5).alias("dy"), (f * -3).alias("dz"))
    return M.error(drift_blinking(spark, sf), truth).select((F.col("error") < 0.025).alias("ok"))


def corrected_near(spark, sf):
    """Of every localization, whether correction brings it back to its site, a constant shift of all aside."""
    l, d = observed_sites(spark, sf), slow_drift(spark, sf)
    put = l.join(d, "frame").select("loc_id", *((F.col(a) - F.col(f"d{a}")).alias(f"{a}_site") for a in "xyz"))
    both = _recovered(spark, sf).corrected.join(put, "loc_id").select("loc_id", *((F.col(a) - F.col(f"{a}_site")).alias(f"d{a}") for a in "xyz"))
    shift = both.agg(*(F.avg(c).alias(f"{c}_mean") for c in DRIFT))
    return both.crossJoin(F.broadcast(shift)).select("loc_id", reduce(lambda p, q: p & q, [F.abs(F.col(c) - F.col(f"{c}_mean")) < 5.0 for c in DRIFT]).alias("near"))  # one row


def optimizers(spark, sf):
    """The drift of the events by each of the minimisers, over the same pairs: whether it comes back within a nanometre,
    and for the bounded one whether it took no more evaluations than plain projected steps do.
    """
    from .plans.estimate import _prepared
    from .plans.optimize import anneal

    l, cfg, frames = observed_sites(spark, sf), replace(_RECOVERY, local_bytes=64 << 20), D.frame_axis_of(locs(spark, sf))
    _, at, blocks, _ = _prepared(l, cfg, None)
    rows, calls = [], {}
    try:
        for name in ("projected", "lbfgsb", "bfgs"):
            mu, trace = anneal(blocks.objective, len(at), cfg.sigma0, cfg.target_sigma_nm, cfg.max_drift_nm * cfg.drift_max_bound_factor, optimizer=name)
            error = M.error(interpolate(frames, at, mu, "cubic"), slow_drift(spark, sf)).first()["error"]
            calls[name] = sum(t["evaluations"] for t in trace)
            rows.append((name, error < WITHIN_NM, name != "lbfgsb" or calls[name] <= calls["projected"]))
    finally:
        blocks.release()
    return spark.createDataFrame(rows, "optimizer string, ok boolean, few boolean")


def given_segmentation(spark, sf):
    """The drift of the events again, over segments of equal counts made beforehand."""
    l = observed_sites(spark, sf)
    seg = S.by_equal_counts(l, 30)
    result = estimate_drift(l, _RECOVERY, seg)
    error = M.error(result.drift_frames, slow_drift(spark, sf)).select((F.col("error") < 2 * WITHIN_NM).alias("ok"))
    return result.drift_segments.agg(F.count("*").alias("n_segments")).crossJoin(error)  # one row each


def optimizer_rounds(spark, sf):
    """The segments in every round that the optimizer has kept as it went along."""
    path = _folder(spark)
    trace = estimate_drift(observed_sites(spark, sf), _RECOVERY, rounds_to=path).trace
    rounds = spark.read.parquet(path).join(trace.select("iteration"), "iteration", "left_semi")
    whole = rounds.select("iteration").distinct().agg((F.count("*") == trace.count()).alias("all_rounds"))
    return rounds.groupBy("segment").agg(F.first("center_frame").alias("center_frame")).crossJoin(whole).transform(_round, "center_frame")  # one row


def details_written(spark, sf):
    """The segments of a finished run with their centers, written with its details and read back."""
    path = _folder(spark)
    sinks.write_details(_recovered(spark, sf), path, slow_drift(spark, sf))
    truth = spark.read.parquet(f"{path}/drift_truth").agg(F.count("*").alias("n_truth"))
    return spark.read.parquet(f"{path}/drift_segments").select("segment", "center_frame").crossJoin(truth).transform(_round, "center_frame")  # one row


def seg_by_mode(spark, sf):
    """The segmentation by each mode's number."""
    l = locs(spark, sf)
    modes = [S.segment(l, v, m).segments.select(F.lit(m).alias("mode"), "segment", "start_frame", "end_frame", "n_locs") for m, v in ((0, 12), (1, LEAST), (2, WINDOW))]
    return reduce(DataFrame.unionByName, modes)


def csv_all(spark, sf):
    """Every column of a CSV file, with its type found."""
    path = _folder(spark)
    _table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).csv(path)
    back = readers.read_csv_all(spark, path)
    return back.select(F.col("p_partkey").cast("long"), "p_name", "p_retailprice")


def custom_written(spark, sf):
    """A drift table written as JSON and read back."""
    path = _folder(spark)
    sinks.write_custom(frame_drift(spark, sf), path, "json")
    return _round(spark.read.schema("frame int, dx double, dy double, dz double").json(path), *DRIFT)


def result_parameters(spark, sf):
    return sinks.parameters(_recovered(spark, sf).params, spark)


QUERIES = {
    "loc_scan": locs,
    "loc_csv_scan": csv_scan,
    "loc_photon_bandpass": lambda s, d: readers.molecule_set(molecules(s, d), {"pixel_size_um": 0.16}, (20_000.0, 60_000.0)).transform(_round, "x", "y", "z"),
    "loc_unit_convert": lambda s, d: readers.molecule_set(molecules(s, d), {"xy_pixel_size_um": 0.16, "z_pixel_size_um": 0.25}).transform(_round, "x", "y", "z"),
    "sim_positions": lambda s, d: readers.simulation(_simulated(s, d)).transform(_round, "x", "y", "z"),
    "sim_ideal_positions": sim_ideal_positions,
    "sim_drift_frames": sim_drift_frames,
    "synthetic_waveform": lambda s, d: synthetic.waveform(s, 500).transform(_round, *DRIFT),
    "synthetic_template": synthetic_template,
    "synthetic_sites": lambda s, d: synthetic.sites_in_cube(s).transform(_round, "x", "y", "z"),
    "synthetic_blinking": lambda s, d: synthetic.blinking(s).transform(_round, "x", "y", "z"),
    "corrected_csv": corrected_csv,
    "thunderstorm_export": thunderstorm_export,
    "molecule_set_export": molecule_set_export,
    "drift_csv": drift_csv,
    "seg_group_by_frame": lambda s, d: S.frame_counts(locs(s, d)),
    "seg_frame_windows": lambda s, d: windows(s, d).segments.transform(_round, "center_frame"),
    "seg_assign_frame_windows": lambda s, d: windows(s, d).assign.select("loc_id", "segment", "valid"),
    "seg_stats": seg_stats,
    "seg_params": seg_params,
    "seg_num_locs": lambda s, d: S.by_count(locs(s, d), LEAST).segments.transform(_round, "center_frame"),
    "seg_assign_num_locs": lambda s, d: S.by_count(locs(s, d), LEAST).assign.select("loc_id", "segment", "valid"),
    "seg_num_windows": seg_num_windows,
    "seg_cap": seg_cap,
    "seg_cap_seeded": seg_cap_seeded,
    "seg_cap_choice": seg_cap_choice,
    "seg_equal_count": lambda s, d: S.by_equal_counts(locs(s, d), 12).segments.transform(_round, "center_frame"),
    "frame_to_segment": lambda s, d: S.frames_of_segments(windows(s, d).segments),
    "seg_coarsen": seg_coarsen,
    "relabel_valid": relabel_valid,
    "min_shift": lambda s, d: P.min_shifted(locs(s, d)).transform(_round, "x", "y", "z"),
    "stride_subsample": stride_subsample,
    "pair_estimate": lambda s, d: P.estimate(locs(s, d), R),
    "pairs_binned": pairs_binned,
    "pairs_radius": pairs_radius,
    "pairs_radius_count": pairs_radius_count,
    "pairs_kd": pairs_kd,
    "pairs_expected": pairs_expected,
    "pairs_radius_flat": pairs_radius_flat,
    "pairs_all": pairs_all,
    "histogram_3d": histogram,
    "cost_value": cost_value,
    "cost_by_segment_pair": cost_by_segment_pair,
    "cost_gradient": cost_gradient,
    "cost_2d": cost_2d,
    "cost_gradient_2d": cost_gradient_2d,
    "cost_3d": cost_3d,
    "cost_gradient_3d": cost_gradient_3d,
    "boxcar_reflect": boxcar_reflect,
    "boxcar_edge": boxcar_edge,
    "interp_catmull_rom": interp_catmull_rom,
    "interp_linear": interp_linear,
    "interp_step": interp_step,
    "interp_cubic": interp_cubic,
    "interp_natural": interp_natural,
    "apply_drift": apply_drift,
    "drift_center": drift_center,
    "drift_error": _compared(M.error, "error"),
    "drift_rms_change": _compared(M.rms_change, "rms_change"),
    "drift_median_change": _compared(M.median_change, "median_change"),
    "drift_mean_distance": _compared(M.mean_distance, "mean_distance"),
    "drift_mean_abs_difference": _compared(M.mean_abs_difference, "mean_abs_difference"),
    "drift_range_ok": drift_range_ok,
    "dataset_summary": lambda s, d: M.summary(locs(s, d)),
    "drift_recovery": _recovery(_RECOVERY),
    "drift_recovery_on_executors": _recovery(replace(_RECOVERY, local_bytes=0)),
    "drift_recovery_on_driver": _recovery(replace(_RECOVERY, local_bytes=256 << 20)),
    "drift_recovery_frames": drift_recovery_frames,
    "self_test": self_test,
    "drift_frames": drift_frames,
    "corrected_locs": corrected_locs,
    "optimizer_trace": optimizer_trace,
    "result_parameters": result_parameters,
    "drift_refined": drift_refined,
    "drift_blinking": drift_blinking,
    "drift_refined_recovery": refined_recovery,
    "drift_blinking_recovery": blinking_recovery,
    "corrected_near": corrected_near,
    "drift_given_segmentation": given_segmentation,
    "optimizer_rounds": optimizer_rounds,
    "optimizers": optimizers,
    "details_written": details_written,
    "seg_by_mode": seg_by_mode,
    "csv_all_columns": csv_all,
    "custom_written": custom_written,
}


# ---- the same in SQL ---------------------------------------------------------------------------------------------------
_LOCS = """locs AS (SELECT event_id AS loc_id, value AS x, user_id * 3.0::DOUBLE AS y, CAST(json_extract(props, '$.k') AS DOUBLE) * 4.0::DOUBLE AS z,
  CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS frame FROM events)"""
_SEG = f"""{_LOCS}, counts AS (SELECT frame, count(*) AS n FROM locs GROUP BY frame),
ranks AS (SELECT frame, CAST((row_number() OVER (ORDER BY frame) - 1) // {WINDOW} AS INT) AS segment FROM counts),
assign AS (SELECT l.*, segment FROM locs l JOIN ranks USING (frame)),
segments AS (SELECT segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_locs, avg(frame) AS center_frame FROM assign GROUP BY segment)"""
_MU = f"""{_SEG}, mu AS (SELECT segment, sin(segment) AS dx, 0.5::DOUBLE * cos(segment) AS dy, segment * 0.1::DOUBLE AS dz FROM segments)"""
_CENTERS = f"""{_MU}, centers AS (SELECT segment, center_frame, dx, dy, dz FROM segments JOIN mu USING (segment))"""
_AXIS = "axis AS (SELECT CAST(unnest(range(0, (SELECT max(frame) + 1 FROM locs))) AS INT) AS frame)"


def _near(table: str, r: float, more: str = "") -> str:
    """All pairs within r by a grid of 27 neighbours."""
    return f"""grid AS (SELECT *, CAST(floor(x / {r}) AS BIGINT) AS bx, CAST(floor(y / {r}) AS BIGINT) AS by_, CAST(floor(z / {r}) AS BIGINT) AS bz FROM {table}),
o AS (SELECT a.v AS ox, b.v AS oy, c.v AS oz FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v)),
far AS (SELECT g.*, bx + ox AS nx, by_ + oy AS ny, bz + oz AS nz FROM grid g, o),
pairs AS (SELECT i.loc_id AS loc_i, j.loc_id AS loc_j, i.x - j.x AS dx0, i.y - j.y AS dy0, i.z - j.z AS dz0{more}
  FROM grid i JOIN far j ON i.bx = j.nx AND i.by_ = j.ny AND i.bz = j.nz AND i.loc_id < j.loc_id
  WHERE (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) + (i.z - j.z) * (i.z - j.z) <= {r * r})"""


_PAIRS = f"{_MU}, {_near('assign', R, ', i.segment AS ti, j.segment AS tj')}"


def _weights(scale: float, norm: str, sign: str, axes: str = "xyz") -> str:
    e = ", ".join(f"d{a}0 {sign} (a.d{a} - b.d{a}) AS e{a}" for a in axes)
    square = " + ".join(f"e{a} * e{a}" for a in axes)
    return f"""{_PAIRS}, e AS (SELECT ti, tj, {e} FROM pairs JOIN mu a ON a.segment = ti JOIN mu b ON b.segment = tj),
w AS (SELECT *, exp(-({square}) / {scale}::DOUBLE) * {norm} AS w FROM e)"""


def _gradient(scale: float, norm: str, sign: str, axes: str = "xyz") -> str:
    f = f"{'-' if sign == '-' else ''}2.0::DOUBLE / {scale}::DOUBLE"
    at = lambda t, s: f"SELECT {t} AS segment, " + ", ".join(f"{s}{f} * w * e{a} AS g{a}" for a in axes) + " FROM w WHERE ti <> tj"
    if sign == "-":
        first, second = at("ti", ""), at("tj", "-1 * ")
    else:
        first, second = at("ti", ""), at("tj", "-")
    return f"WITH {_weights(scale, norm, sign, axes)}, g AS ({first} UNION ALL {second}) SELECT segment, " + ", ".join(f"round(sum(g{a}), 6) + 0.0::DOUBLE AS g{a}" for a in axes) + " FROM g GROUP BY segment"


_G = (4 * SIGMA * SIGMA, f"(1.0::DOUBLE / {SIGMA}::DOUBLE)", "-")


def _by_count(least: str) -> str:
    return f"""{_LOCS}, counts AS (SELECT frame, count(*) AS n, row_number() OVER (ORDER BY frame) AS i FROM locs GROUP BY frame),
whole AS (SELECT sum(n)::BIGINT AS total, max(i) AS last, {least} AS least FROM counts),
run(i, frame, segment, held, closed) AS (
  SELECT i, frame, 0::BIGINT, n::BIGINT, n >= least AND (total - n >= least OR i = last) FROM counts, whole WHERE i = 1
  UNION ALL
  SELECT c.i, c.frame, r.segment + CAST(r.closed AS BIGINT), h, h >= least AND (total - h >= least OR c.i = last)
  FROM (SELECT r.*, c.i AS ci, CASE WHEN r.closed THEN c.n ELSE r.held + c.n END::BIGINT AS h FROM run r JOIN counts c ON c.i = r.i + 1) r
  JOIN counts c ON c.i = r.ci, whole),
done AS (SELECT max(segment) AS last_closed FROM run WHERE closed),
frames AS (SELECT frame, CAST(CASE WHEN segment <= last_closed THEN segment ELSE -1 END AS INT) AS segment FROM run, done),
assign AS (SELECT l.*, segment FROM locs l JOIN frames USING (frame))"""


_DESCRIBED = "SELECT segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_locs, round(avg(frame), 6) AS center_frame FROM assign WHERE segment >= 0 GROUP BY segment"
_R3 = "round(dx, 6) + 0.0::DOUBLE AS dx, round(dy, 6) + 0.0::DOUBLE AS dy, round(dz, 6) + 0.0::DOUBLE AS dz"
_DRIFT = f"{_LOCS}, {_AXIS}, drift AS (SELECT frame, frame * 0.01::DOUBLE AS dx, frame * -0.005::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM axis)"
_TWO = f"{_DRIFT}, other AS (SELECT frame, frame * 0.011::DOUBLE AS dx, sin(frame / 50.0::DOUBLE) AS dy, 1.0::DOUBLE AS dz FROM axis), d AS (SELECT frame, a.dx - b.dx AS ex, a.dy - b.dy AS ey, a.dz - b.dz AS ez FROM drift a JOIN other b USING (frame))"
_MOL = """m AS (SELECT l_orderkey * 8 + l_linenumber AS loc_id, l_partkey::DOUBLE AS px, l_suppkey::DOUBLE AS py, l_linenumber::DOUBLE AS pz, l_extendedprice AS photons, CAST(datediff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS INT) AS frame FROM lineitem)"""
_CELL = R * (1 + 2 * P.MARGIN)
_CELLS = lambda size, bounded: "cells AS (SELECT loc_id, " + ", ".join((f"CAST(least(floor(({a} - {a}0) / {size}::DOUBLE), greatest(ceil(({a}1 - {a}0) / {size}::DOUBLE), 1) - 1) AS BIGINT)" if bounded else f"CAST(floor(({a} - {a}0) / {size}::DOUBLE) AS BIGINT)") + f" AS c{a}" for a in "xyz") + " FROM locs, (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM locs))"


def _box(index: str, lo: int, hi: int, width: int) -> str:
    return f"WITH {_CENTERS}, n AS (SELECT count(*) AS n FROM centers), asked AS (SELECT segment AS at, {index} AS segment FROM (SELECT c.segment, c.segment + k.k AS q, n FROM centers c, n, (SELECT unnest(range({lo}, {hi + 1})) AS k) k)) SELECT a.at AS segment, " + ", ".join(f"round(sum(c.{d}) / {width}, 6) + 0.0::DOUBLE AS {d}" for d in DRIFT) + " FROM asked a JOIN centers c ON c.segment = a.segment GROUP BY a.at"


def _catmull(c: str) -> str:
    return f"CASE WHEN r.k IS NULL THEN 0 ELSE 0.5::DOUBLE * (2 * {c}1 + ({c}2 - {c}0) * t + (2 * {c}0 - 5 * {c}1 + 4 * {c}2 - {c}3) * t * t + (3 * {c}1 - {c}0 - 3 * {c}2 + {c}3) * t * t * t) END"


def _share(of: str, seed: int, salt: int) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {of}, '{seed}', '{salt}')), 1, 10))::BIGINT / 1099511627776.0::DOUBLE)"


def _normal(salt: int) -> str:
    return f"sqrt(-2 * ln(1 - {_share('id', 1, salt)})) * cos(2 * pi() * {_share('id', 1, salt + 1)})"


_KNOTS = "k AS (SELECT segment AS k, center_frame AS x1, lead(center_frame) OVER w AS x2, count(*) OVER () AS n, " + ", ".join(f"lag({d}) OVER w AS {d}0, {d} AS {d}1, lead({d}) OVER w AS {d}2, lead({d}, 2) OVER w AS {d}3" for d in DRIFT) + " FROM centers WINDOW w AS (ORDER BY center_frame))"

ORACLES = {
    "loc_scan": f"WITH {_LOCS} SELECT * FROM locs",
    "loc_csv_scan": f"WITH {_LOCS} SELECT loc_id, x, y, 0.0::DOUBLE AS z, frame FROM locs",
    "loc_photon_bandpass": f"WITH {_MOL} SELECT loc_id, round(px * 160, 6) AS x, round(py * 160, 6) AS y, round(pz * 160, 6) AS z, frame FROM m WHERE photons > 20000 AND photons < 60000",
    "loc_unit_convert": f"WITH {_MOL} SELECT loc_id, round(px * 160, 6) AS x, round(py * 160, 6) AS y, round(pz * 250, 6) AS z, frame FROM m",
    "sim_positions": f"WITH {_MOL} SELECT loc_id, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, frame FROM m",
    "sim_ideal_positions": f"WITH {_MOL} SELECT loc_id, round(p_retailprice + 0.01::DOUBLE * frame, 6) + 0.0::DOUBLE AS x, round(p_size * 10.0::DOUBLE - 0.005::DOUBLE * frame, 6) + 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, frame FROM m JOIN part ON p_partkey = CAST(px AS BIGINT)",
    "sim_drift_frames": "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INT) AS frame, round(r_regionkey * 1.0::DOUBLE, 6) AS dx, round(r_regionkey * -2.0::DOUBLE, 6) + 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM region",
    "synthetic_waveform": "WITH t AS (SELECT CAST(unnest(range(0, 500)) AS INT) AS frame), b AS (SELECT frame, (3 * sin(frame / 20.0::DOUBLE + 0.37::DOUBLE) + 1.25::DOUBLE * cos(frame / 6.0::DOUBLE + 1.2::DOUBLE) + frame / 25.0::DOUBLE) * 10 AS b FROM t) SELECT frame, round(b, 6) AS dx, round(b * 0.7::DOUBLE, 6) AS dy, round(b * -0.5::DOUBLE, 6) + 0.0::DOUBLE AS dz FROM b",
    "synthetic_template": "WITH f AS (SELECT CAST(unnest(range(0, 20)) AS INT) AS frame) SELECT CAST(frame * 1000000 + n_nationkey AS BIGINT) AS loc_id, round(n_nationkey * 5000.0::DOUBLE + 5 * sin(frame / 19.0::DOUBLE * (4 * pi())) + frame / 19.0::DOUBLE * 20, 6) + 0.0::DOUBLE AS x, round(n_regionkey * 5000.0::DOUBLE + frame / 19.0::DOUBLE * 5, 6) AS y, 0.0::DOUBLE AS z, frame FROM nation, f",
    "synthetic_sites": f"WITH l AS (SELECT CAST(id AS BIGINT) AS loc_id, CAST(id // 120 AS INT) AS frame, CAST(floor({_share('id', 123, 0)} * 1000) AS BIGINT) AS site FROM (SELECT unnest(range(0, 60000)) AS id)), b AS (SELECT *, (3 * sin(frame / 20.0::DOUBLE + 0.37::DOUBLE) + 1.25::DOUBLE * cos(frame / 6.0::DOUBLE + 1.2::DOUBLE) + frame / 25.0::DOUBLE) * 10 AS b FROM l) SELECT loc_id, " + ", ".join(f"round({_share('site', 123, k + 1)} * 1000 + b * {f}::DOUBLE, 6) + 0.0::DOUBLE AS {a}" for k, (a, f) in enumerate((("x", 1.0), ("y", 0.7), ("z", -0.5)))) + ", frame FROM b",
    "synthetic_blinking": f"WITH m AS (SELECT id, id // 40 AS m, CAST(floor({_share('id', 1, 9)} * 100) AS INT) AS frame FROM (SELECT unnest(range(0, 800)) AS id)) SELECT CAST(id AS BIGINT) AS loc_id, " + ", ".join(f"round({_share('m', 1, 20 + k)} * 10 + {_normal(30 + 2 * k)} * 0.05::DOUBLE + frame / 100.0::DOUBLE * {f * 0.05}::DOUBLE, 6) + 0.0::DOUBLE AS {a}" for k, (a, f) in enumerate((("x", 2.0), ("y", 5.0), ("z", -3.0)))) + ", frame FROM m",
    "interp_cubic": f"WITH {_LOCS}, {_AXIS}, t AS (SELECT frame, frame / 100.0::DOUBLE AS t FROM axis) SELECT frame, round(t * t * t - 4 * t * t, 4) + 0.0::DOUBLE AS dx, round(2 * t * t - t, 4) + 0.0::DOUBLE AS dy, round(3 - t, 4) + 0.0::DOUBLE AS dz FROM t",
    # through (-1, 0), (0, 1), (1, 0): the second derivative at 0 is -3, and 0 at the ends, whose slopes are 3/2 and -3/2
    "interp_natural": f"WITH {_LOCS}, {_AXIS}, u AS (SELECT frame, abs(frame / ((SELECT max(frame) FROM locs) / 4.0::DOUBLE) - 2) AS u FROM axis), v AS (SELECT frame, CASE WHEN u <= 1 THEN 1 - 1.5::DOUBLE * u * u + 0.5::DOUBLE * u * u * u ELSE 1.5::DOUBLE * (1 - u) END AS v FROM u) SELECT frame, round(3 * v, 4) + 0.0::DOUBLE AS dx, round(-7 * v, 4) + 0.0::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM v",
    "drift_recovery": f"WITH {_LOCS} SELECT count(*) AS n_locs, max(frame) AS last_frame, true AS ok FROM locs",
    "drift_recovery_on_executors": f"WITH {_LOCS} SELECT count(*) AS n_locs, max(frame) AS last_frame, true AS ok FROM locs",
    "drift_recovery_on_driver": f"WITH {_LOCS} SELECT count(*) AS n_locs, max(frame) AS last_frame, true AS ok FROM locs",
    "drift_recovery_frames": f"WITH {_LOCS}, {_AXIS} SELECT frame, true AS near FROM axis",
    "self_test": "SELECT true AS ok",
    "corrected_csv": f"""WITH {_LOCS} SELECT loc_id AS id, frame, printf('%.3f', x - floor(frame / 10.0::DOUBLE) / 8.0::DOUBLE) AS "x [nm]", printf('%.3f', y - 0.5::DOUBLE) AS "y [nm]", printf('%.3f', z + 0.25::DOUBLE) AS "z [nm]", printf('%.3f', x * 2) AS intensity FROM locs""",
    "thunderstorm_export": f"WITH {_LOCS} SELECT row_number() OVER (ORDER BY loc_id) - 1 AS id, frame, printf('%.3f', x) AS x_nm, printf('%.3f', y) AS y_nm, printf('%.3f', z) AS z_nm FROM locs",
    "molecule_set_export": f"WITH {_LOCS} SELECT round((y / 160)::FLOAT::DOUBLE, 4) AS \"X_POS_PIXELS\", round((x / 160)::FLOAT::DOUBLE, 4) AS \"Y_POS_PIXELS\", round((z / 160)::FLOAT::DOUBLE, 4) AS \"Z_POS_PIXELS\", round((5.0::DOUBLE / 160)::FLOAT::DOUBLE, 4) AS \"PRECISION_XY_PIXELS\", round(0.1::FLOAT::DOUBLE, 4) AS \"PRECISION_Z_PIXELS\", 1000.0::DOUBLE AS \"PHOTONS\", 0::INT AS \"CHANNEL\", frame AS \"FRAME_NUMBER\", row_number() OVER (ORDER BY loc_id) - 1 AS \"INDEX\" FROM locs",
    "drift_csv": f"WITH {_DRIFT} SELECT frame::DOUBLE AS frame, dx AS x_nm, dy AS y_nm, dz AS z_nm FROM drift",
    "seg_group_by_frame": f"WITH {_LOCS} SELECT frame, count(*) AS n FROM locs GROUP BY frame",
    "seg_frame_windows": f"WITH {_SEG} {_DESCRIBED}",
    "seg_stats": f"WITH {_SEG} {_DESCRIBED}",
    "seg_assign_frame_windows": f"WITH {_SEG} SELECT loc_id, segment, true AS valid FROM assign",
    "seg_params": f"WITH {_SEG}, v AS (SELECT *, row_number() OVER (PARTITION BY segment) <= {CAP} AS valid FROM assign) SELECT count(DISTINCT segment) AS n_segments, count(*) AS n_locs, count(*) FILTER (valid) AS n_locs_valid, count(*) FILTER (NOT valid) AS n_locs_invalid, {WINDOW}::INT AS frames_per_window, -1::INT AS min_n_locs_per_window FROM v",
    "seg_num_locs": f"WITH RECURSIVE {_by_count(str(LEAST))} {_DESCRIBED}",
    "seg_assign_num_locs": f"WITH RECURSIVE {_by_count(str(LEAST))} SELECT loc_id, segment, segment >= 0 AS valid FROM assign",
    "seg_num_windows": f"WITH RECURSIVE {_by_count('CAST(ceil(sum(n) / 12.0::DOUBLE) AS BIGINT)')} {_DESCRIBED}",
    "seg_cap": f"WITH {_SEG} SELECT loc_id, segment, row_number() OVER (PARTITION BY segment ORDER BY loc_id) <= {CAP} AS valid FROM assign",
    "seg_cap_seeded": f"WITH {_SEG}, h AS (SELECT *, ('0x' || substr(md5(loc_id || ':{SEED}'), 1, 15))::BIGINT AS h FROM assign) SELECT loc_id, segment, row_number() OVER (PARTITION BY segment ORDER BY h, loc_id) <= {CAP} AS valid FROM h",
    "relabel_valid": f"WITH {_SEG}, v AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY loc_id) AS k FROM assign) SELECT loc_id, x, y, z, segment AS frame FROM v WHERE k <= {CAP}",
    "seg_cap_choice": f"WITH {_LOCS}, n AS (SELECT count(*) AS n, count(DISTINCT frame) AS f FROM locs) SELECT 0::INT AS mode, CAST(floor((n // 12) * 0.5::DOUBLE) AS BIGINT) AS max_locs_per_segment FROM n UNION ALL SELECT 1, CAST(floor({LEAST} * 0.5::DOUBLE) AS BIGINT) FROM n UNION ALL SELECT 2, CAST(floor(n * {WINDOW}::DOUBLE / f * 0.5::DOUBLE) AS BIGINT) FROM n",
    "seg_equal_count": f"WITH {_LOCS}, r AS (SELECT *, row_number() OVER (ORDER BY frame, loc_id) - 1 AS rn, count(*) OVER () AS total FROM locs), assign AS (SELECT *, CAST(least(rn // greatest(total // 12, 1), 11) AS INT) AS segment FROM r) {_DESCRIBED}",
    "frame_to_segment": f"WITH {_SEG}, e AS (SELECT segment, coalesce(lag(end_frame) OVER (ORDER BY segment) + 1, 0) AS a, end_frame AS b FROM segments) SELECT CAST(unnest(range(a, b + 1)) AS INT) AS frame, segment FROM e",
    "seg_coarsen": f"WITH {_SEG} SELECT CAST(segment // 3 AS INT) AS segment, count(*) AS n_segments, round(avg(center_frame), 6) AS center_frame, CAST(sum(n_locs) AS BIGINT) AS n_locs FROM segments GROUP BY segment // 3",
    "min_shift": f"WITH {_LOCS} SELECT loc_id, round(x - min(x) OVER (), 6) AS x, round(y - min(y) OVER (), 6) AS y, round(z - min(z) OVER (), 6) AS z, frame FROM locs",
    "stride_subsample": f"WITH {_LOCS} SELECT * FROM locs WHERE loc_id % 10 = 0",
    "pair_estimate": f"WITH {_LOCS}, {_CELLS(R, False)}, n AS (SELECT count(*) AS n FROM cells GROUP BY cx, cy, cz) SELECT CAST(sum(n * (n - 1)) AS BIGINT) AS n_pairs, CAST(round_even(sum(n * (n - 1))::DOUBLE / 10000, 0) * 10000 AS BIGINT) AS n_pairs_rounded FROM n",
    "pairs_binned": f"WITH {_LOCS}, {_CELLS(R, True)} SELECT count(*) AS n_pairs, CAST(sum(i.loc_id + 3 * j.loc_id) AS BIGINT) AS checksum FROM cells i JOIN cells j USING (cx, cy, cz) WHERE i.loc_id < j.loc_id",
    "pairs_radius": f"WITH {_LOCS}, {_near('locs', R)} SELECT loc_i, loc_j, round(dx0, 6) + 0.0::DOUBLE AS dx0, round(dy0, 6) + 0.0::DOUBLE AS dy0, round(dz0, 6) + 0.0::DOUBLE AS dz0 FROM pairs",
    "pairs_expected": f"WITH {_LOCS}, g AS (SELECT CAST(floor(x / {_CELL}::DOUBLE) AS BIGINT) AS a, CAST(floor(y / {_CELL}::DOUBLE) AS BIGINT) AS b, CAST(floor(z / {_CELL}::DOUBLE) AS BIGINT) AS c, count(*) AS n FROM locs GROUP BY ALL), o AS (SELECT i.v AS i, j.v AS j, k.v AS k FROM (VALUES (-1), (0), (1)) i(v), (VALUES (-1), (0), (1)) j(v), (VALUES (-1), (0), (1)) k(v)) SELECT CAST((SELECT sum(g.n * h.n) FROM g, o, g h WHERE h.a = g.a + i AND h.b = g.b + j AND h.c = g.c + k) - (SELECT sum(n) FROM g) AS BIGINT) // 2 AS n_candidates, true AS near",
    "pairs_kd": f"WITH {_LOCS}, {_near('locs', R)} SELECT loc_i, loc_j, round(dx0, 6) + 0.0::DOUBLE AS dx0, round(dy0, 6) + 0.0::DOUBLE AS dy0, round(dz0, 6) + 0.0::DOUBLE AS dz0 FROM pairs",
    "pairs_radius_count": f"WITH {_LOCS}, {_near('locs', R)} SELECT count(*) AS n_pairs FROM pairs",
    "pairs_radius_flat": f"WITH {_LOCS}, flat AS (SELECT loc_id, x, y, 0.0::DOUBLE AS z FROM locs), {_near('flat', 5.0)} SELECT count(*) AS n_pairs FROM pairs",
    "pairs_all": "SELECT i.n_nationkey AS loc_i, j.n_nationkey AS loc_j FROM nation i JOIN nation j ON i.n_nationkey < j.n_nationkey",
    "histogram_3d": f"WITH {_LOCS}, {_CELLS(40.0, True)}, k AS (SELECT *, row_number() OVER (ORDER BY cx, cy, cz, loc_id) - 1 AS k FROM cells) SELECT cx, cy, cz, min(k) AS first, count(*) AS n, string_agg(loc_id::VARCHAR, ',' ORDER BY loc_id) AS loc_ids FROM k GROUP BY cx, cy, cz, k // 64",
    "cost_value": f"WITH {_weights(*_G)} SELECT round(-sum(w), 4) AS cost FROM w",
    "cost_by_segment_pair": f"WITH {_weights(*_G)} SELECT ti AS segment_i, tj AS segment_j, count(*) AS n_pairs, round(sum(w), 6) AS w, round(sum(w * ex), 6) + 0.0::DOUBLE AS mx, round(sum(w * ey), 6) + 0.0::DOUBLE AS my, round(sum(w * ez), 6) + 0.0::DOUBLE AS mz FROM w GROUP BY ti, tj",
    "cost_gradient": _gradient(*_G),
    "cost_2d": f"WITH {_weights(100.0, '1', '+', 'xy')} SELECT round(-sum(w), 4) AS cost FROM w",
    "cost_gradient_2d": _gradient(100.0, "1", "+", "xy"),
    "cost_3d": f"WITH {_weights(100.0, '1', '+')} SELECT round(-sum(w), 4) AS cost FROM w",
    "cost_gradient_3d": _gradient(100.0, "1", "+"),
    "boxcar_reflect": _box("CAST(CASE WHEN ((q % (2 * n)) + 2 * n) % (2 * n) >= n THEN 2 * n - 1 - ((q % (2 * n)) + 2 * n) % (2 * n) ELSE ((q % (2 * n)) + 2 * n) % (2 * n) END AS INT)", -1, 2, 4),
    "boxcar_edge": _box("CAST(greatest(least(q, n - 1), 0) AS INT)", -2, 2, 5),
    "interp_catmull_rom": f"WITH {_CENTERS}, {_AXIS}, {_KNOTS}, r AS (SELECT a.frame, k.*, (a.frame - k.x1) / (k.x2 - k.x1) AS t FROM axis a LEFT JOIN k ON k.k >= 1 AND k.k <= n - 3 AND (a.frame >= x1 AND a.frame < x2 OR k.k = n - 3 AND a.frame = x2)) SELECT frame, " + ", ".join(f"round({_catmull(d)}, 6) + 0.0::DOUBLE AS {d}" for d in DRIFT) + " FROM r",
    "interp_linear": f"WITH {_CENTERS}, {_AXIS}, k AS (SELECT segment AS k, center_frame AS xa, lead(center_frame) OVER w AS xb, count(*) OVER () AS n, " + ", ".join(f"{d} AS {d}a, lead({d}) OVER w AS {d}b" for d in DRIFT) + " FROM centers WINDOW w AS (ORDER BY center_frame)) SELECT frame, " + ", ".join(f"round({d}a + (frame - xa) / (xb - xa) * ({d}b - {d}a), 6) + 0.0::DOUBLE AS {d}" for d in DRIFT) + " FROM axis JOIN k ON xb IS NOT NULL AND (frame >= xa OR k = 0) AND (frame < xb OR k = n - 2)",
    "interp_step": f"WITH {_MU}, e AS (SELECT segment, coalesce(lag(end_frame) OVER (ORDER BY segment) + 1, 0) AS a, end_frame AS b FROM segments), f AS (SELECT CAST(unnest(range(a, b + 1)) AS INT) AS frame, segment FROM e) SELECT frame, {_R3} FROM f JOIN mu USING (segment)",
    "apply_drift": f"WITH {_DRIFT} SELECT loc_id, round(x - dx, 6) + 0.0::DOUBLE AS x, round(y - dy, 6) + 0.0::DOUBLE AS y, round(z - dz, 6) + 0.0::DOUBLE AS z, frame FROM locs JOIN drift USING (frame)",
    "drift_center": f"WITH {_DRIFT}, c AS (SELECT frame, dx - avg(dx) OVER () AS dx, dy - avg(dy) OVER () AS dy, dz - avg(dz) OVER () AS dz FROM drift) SELECT frame, {_R3} FROM c",
    "drift_error": f"WITH {_TWO} SELECT round((stddev_pop(ex) + stddev_pop(ey) + stddev_pop(ez)) / 3, 6) AS error FROM d",
    "drift_rms_change": f"WITH {_TWO} SELECT round(sqrt(avg((ex * ex + ey * ey + ez * ez) / 3)), 6) AS rms_change FROM d",
    "drift_median_change": f"WITH {_TWO}, c AS (SELECT ex * ex AS c FROM d UNION ALL SELECT ey * ey FROM d UNION ALL SELECT ez * ez FROM d) SELECT round(median(c), 6) AS median_change FROM c",
    "drift_mean_distance": f"WITH {_TWO} SELECT round(avg(sqrt(ex * ex + ey * ey + ez * ez)), 6) AS mean_distance FROM d",
    "drift_mean_abs_difference": f"WITH {_TWO} SELECT round(avg(abs(ex) + abs(ey) + abs(ez)) / 4, 6) AS mean_abs_difference FROM d",
    "drift_range_ok": f"WITH {_DRIFT}, s AS (SELECT (max(dx) - min(dx)) * 0.5::DOUBLE AS a, (max(dy) - min(dy)) * 0.5::DOUBLE AS b, (max(dz) - min(dz)) * 0.5::DOUBLE AS c FROM drift) SELECT round(a, 6) AS dx_range, round(b, 6) AS dy_range, round(c, 6) AS dz_range, a <= 5 AND b <= 5 AND c <= 5 AS ok FROM s",
    "dataset_summary": f"WITH {_LOCS} SELECT count(*) AS n_locs, count(DISTINCT frame) AS n_frames, max(frame) AS max_frame, max(greatest(abs(x), abs(y), abs(z))) AS max_abs FROM locs",
}

#: F6 in SQL, and its segments of 24 frames.
_SITES = """sites AS (SELECT event_id AS loc_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS frame, user_id AS u, CAST(floor(value) AS BIGINT) % 5 - 2 AS ex, event_id % 5 - 2 AS ey FROM events),
assign AS (SELECT loc_id, frame, CAST(k.segment AS INT) AS segment, u % 17 * 400.0::DOUBLE + ex + 40 * sin(frame / 180.0::DOUBLE) AS x, (u // 17) % 17 * 400.0::DOUBLE + ey + 0.06::DOUBLE * frame AS y, (u // 289) * 400.0::DOUBLE + 25 * cos(frame / 150.0::DOUBLE) AS z
  FROM sites JOIN (SELECT frame, (row_number() OVER (ORDER BY frame) - 1) // 24 AS segment FROM (SELECT DISTINCT frame FROM sites)) k USING (frame)),
segments AS (SELECT segment, round(avg(frame), 6) AS center_frame FROM assign GROUP BY segment)"""


def _parameters() -> str:
    """Settings as they are written, beside what the data give."""
    given = asdict(_RECOVERY) | {"frames_per_window": 24, "min_n_locs_per_window": -1, "n_locs_invalid": 0}
    rows = [f"SELECT '{k}' AS key, '{v}' AS value" for k, v in given.items()]
    rows += [f"SELECT '{k}', CAST(count(*) AS VARCHAR) FROM {t}" for k, t in (("n_segments", "segments"), ("n_locs", "assign"), ("n_locs_valid", "assign"), ("n_pairs", "pairs"))]
    return f"WITH {_SITES}, {_near('assign', 100.0)} " + " UNION ALL ".join(rows)


_MODES = {0: _by_count("CAST(ceil(sum(n) / 12.0::DOUBLE) AS BIGINT)"), 1: _by_count(str(LEAST))}
_BOUNDS = "segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_locs FROM assign WHERE segment >= 0 GROUP BY segment"
ORACLES |= {
    "result_parameters": _parameters(),
    "optimizers": "SELECT o AS optimizer, true AS ok, true AS few FROM (VALUES ('projected'), ('lbfgsb'), ('bfgs')) o(o)",
    "drift_refined_recovery": "SELECT true AS ok",
    "drift_blinking_recovery": "SELECT true AS ok",
    "corrected_near": "SELECT event_id AS loc_id, true AS near FROM events",
    "drift_given_segmentation": "SELECT 30::BIGINT AS n_segments, true AS ok",
    "optimizer_rounds": f"WITH {_SITES} SELECT segment, center_frame, true AS all_rounds FROM segments",
    "details_written": f"WITH {_SITES} SELECT segment, center_frame, (SELECT max(frame) + 1 FROM assign)::BIGINT AS n_truth FROM segments",
    "seg_by_mode": f"SELECT * FROM (WITH RECURSIVE {_MODES[0]} SELECT 0::INT AS mode, {_BOUNDS}) UNION ALL SELECT * FROM (WITH RECURSIVE {_MODES[1]} SELECT 1::INT AS mode, {_BOUNDS}) UNION ALL SELECT * FROM (WITH {_SEG} SELECT 2::INT AS mode, {_BOUNDS})",
    "csv_all_columns": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "custom_written": f"WITH {_DRIFT} SELECT frame, {_R3} FROM drift",
}
