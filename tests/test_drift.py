import math
import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import spline
from plumbline.operators import cost as C
from plumbline.operators import drift as D
from plumbline.operators import metrics as M
from plumbline.operators import moments as X
from plumbline.operators import pairs as P
from plumbline.operators import segment as S
from plumbline.plans import estimate as E
from plumbline.plans.minimisers import dfp, lbfgsb, projected, strong_wolfe
from plumbline.plans.optimize import anneal, one_level, optimized, reflect_boxcar
from plumbline.schema import LOCS, DriftConfig
from plumbline.sources import readers, sinks, synthetic


def frame_of(spark, rows):
    return spark.createDataFrame(rows, LOCS)


def cloud(n, frames=6, seed=1, size=60.0):
    r = random.Random(seed)
    return [(i, r.uniform(-size, size), r.uniform(-size, size), r.uniform(-size, size), r.randrange(frames)) for i in range(n)]


def literal_by_count(frames, least):
    """The sequential rule, frame by frame."""
    out, number, held, opened = {}, 0, 0, []
    for i, f in enumerate(sorted(set(frames))):
        held += frames.count(f)
        opened.append(f)
        if held >= least and (len(frames) - held >= least or i == len(set(frames)) - 1):
            out |= dict.fromkeys(opened, number)
            number, held, opened = number + 1, 0, []
    return out | dict.fromkeys(opened, -1)


@pytest.mark.parametrize("least", [1, 7, 30, 1000])
def test_by_count_equals_the_sequential_rule(spark, least):
    rows = cloud(90, 23)
    got = {r.frame: r.segment for r in S.by_count(frame_of(spark, rows), least).assign.collect()}
    assert got == literal_by_count([r[4] for r in rows], least)


def test_segments_of_edge_cases(spark):
    empty = frame_of(spark, [])
    assert S.by_frame_windows(empty, 5).segments.count() == 0
    assert S.by_count(empty, 5).segments.count() == 0
    one = frame_of(spark, [(1, 0.0, 0.0, 0.0, 7)])
    assert S.by_frame_windows(one, 5).segments.first()[:4] == (0, 7, 7, 1)
    gaps = frame_of(spark, [(k, 0.0, 0.0, 0.0, f) for k, f in enumerate((0, 5, 100, 101))])
    assert [(r.start_frame, r.end_frame) for r in S.by_frame_windows(gaps, 2).segments.orderBy("segment").collect()] == [(0, 5), (100, 101)]
    assert S.by_frame_windows(gaps, 2, 0).assign.filter("valid").count() == 4  # a cap of 0 is none
    assert S.by_frame_windows(gaps, 2, 1).assign.filter("valid").count() == 2


def test_cap_is_reproducible(spark):
    locs = frame_of(spark, cloud(200))
    pick = lambda n: {r.loc_id for r in S.by_frame_windows(locs.repartition(n), 2, 20, seed=3).assign.filter("valid").collect()}
    assert pick(2) == pick(5)


@pytest.mark.parametrize("cap", [1, 7, 20, 1000])
def test_the_seeded_choice_is_that_of_the_least_hashes(spark, cap):
    """Exactly ``cap`` rows of a segment, ids that repeat (and so tie) included."""
    import hashlib

    rows = [(k if k % 3 else 5, 1.0 * k, 0.0, 0.0, k % 4) for k in range(160)]
    got = S.by_frame_windows(frame_of(spark, rows), 2, cap, seed=3).assign.collect()
    key = lambda i: (int(hashlib.md5(f"{i}:3".encode()).hexdigest()[:15], 16), i)
    for segment in (0, 1):
        here = [r for r in got if r.segment == segment]
        chosen = sorted(key(r.loc_id) for r in here if r.valid)
        assert chosen == sorted(key(r.loc_id) for r in here)[:cap] and len(here) == 80
    assert len(got) == 160


def test_a_hot_segment_is_not_put_in_order(spark):
    """Rows away from the edge of the choice are marked where they are: none of them passes through a window."""
    plan = S.by_frame_windows(frame_of(spark, cloud(50)), 2, 20).assign._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(segment" not in plan


@pytest.mark.parametrize("radius", [3.0, 15.0, 500.0])
def test_pairs_equal_brute_force(spark, radius):
    rows = cloud(120) + [(900, 0.0, 0.0, 0.0, 0), (901, radius, 0.0, 0.0, 1), (902, 0.0, 0.0, 0.0, 1)]
    got = {(r.loc_i, r.loc_j): (r.dx0, r.dy0, r.dz0) for r in P.within_radius(frame_of(spark, rows), radius).collect()}
    want = {(a[0], b[0]): tuple(a[k] - b[k] for k in (1, 2, 3)) for a in rows for b in rows if a[0] < b[0] and sum((a[k] - b[k]) ** 2 for k in (1, 2, 3)) <= radius * radius}
    assert got == want and (900, 901) in got


@pytest.mark.parametrize("flat", [False, True])
def test_rows_that_share_an_id_are_paired(spark, flat):
    """Rows are paired, not ids: in one cell or across, with null ids and with rows repeated as a whole."""
    r = random.Random(9)
    rows = [(r.choice((None, 1, 2, 2, 3)), round(r.uniform(-9, 9), 1), round(r.uniform(-9, 9), 1), 0.0 if flat else round(r.uniform(-9, 9), 1), 0) for _ in range(90)]
    rows += rows[:20] + [(1, 0.5, 0.0, 0.0, 0), (1, 1.0, 0.0, 0.0, 0), (2, -0.5, 0.0, 0.0, 0), (2, 0.25, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, z double, frame int")
    got = sorted(((p.loc_i, p.loc_j, round(abs(p.dx0), 6), round(abs(p.dy0), 6), round(abs(p.dz0), 6)) for p in P.within_radius(df, 1.5, flat=flat).collect()), key=str)
    want = []
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if sum((a[c] - b[c]) ** 2 for c in (1, 2, 3)) <= 1.5 * 1.5:
                i, j = sorted((a[0], b[0]), key=lambda v: (v is None, v or 0))
                want.append((i, j, *(round(abs(a[c] - b[c]), 6) for c in (1, 2, 3))))
    assert got == sorted(want, key=str) and len(want) > 30


def test_rows_that_share_an_id_are_paired_in_cells_and_all_in_all(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0), (1, 0.1, 0.0, 0.0, 0), (2, 0.2, 0.0, 0.0, 0), (2, 0.3, 0.0, 0.0, 0), (None, 0.3, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "loc_id long, x double, y double, z double, frame int")
    want = [(1, 1), (1, 2), (1, 2), (1, 2), (1, 2), (1, None), (1, None), (2, 2), (2, None), (2, None)]
    for pairs in (P.within_cells(df, 5.0), P.every_pair(df)):
        assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)


def test_a_cell_of_many_rows_is_many_rows_of_the_index(spark):
    rows = [(k, 0.0 if k < 900 else 10.0 * (k % 5), 0.0, 0.0, 0) for k in range(1000)]
    got = sorted(P.histogram(frame_of(spark, rows), 10.0, 64).collect(), key=lambda r: r.first)
    assert max(r.n for r in got) <= 64 and [r.n for r in got] == [len(r.loc_ids) for r in got]
    assert [r.first for r in got] == [sum(x.n for x in got[:k]) for k in range(len(got))]  # one list without gaps
    size = {k: v for k, v in ((0, 920), (1, 20), (2, 20), (3, 40))}  # the last cell takes its upper edge
    for cx, n in size.items():
        here = [i for r in got if r.cx == cx for i in r.loc_ids]
        assert len(here) == n and here == sorted(here)


@pytest.mark.parametrize("sampled", [40, 400])
def test_expected_pairs(spark, sampled):
    """Within the bounds told, which are none for a table that is counted as a whole; candidates are never fewer."""
    r = random.Random(5)
    rows = [(k, r.gauss(0, 30), r.gauss(0, 30), r.choice((0.0, 40.0)), 0) for k in range(400)] + [(k, 500.0, 500.0, 0.0, 0) for k in range(30)]
    true = sum(sum((a[c] - b[c]) ** 2 for c in (1, 2, 3)) <= 100 for i, a in enumerate(rows) for b in rows[:i])
    got = P.expected(frame_of(spark, rows), 10.0, sampled).first()
    assert got.n_least <= true <= got.n_most <= got.n_candidates and (sampled == 40 or got.n_pairs == true)
    assert tuple(P.expected(frame_of(spark, []), 10.0).first()) == (0, 0, 0, 0)


def test_pairs_on_cell_edges(spark):
    """Distances of just the radius, coordinates on the edges of cells, and far from the origin."""
    for far in (0.0, 1e6, -1e7):
        rows = [(k, far + 2.5 * (k % 5), -2.5 * (k // 5 % 3), 2.5 * (k // 15), 0) for k in range(45)]
        got = {(p.loc_i, p.loc_j) for p in P.within_radius(frame_of(spark, rows), 2.5, unique=True).collect()}
        got5 = {(p.loc_i, p.loc_j) for p in P.within_radius(frame_of(spark, rows), 5.0).collect()}
        near = lambda r: {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum((a[c] - b[c]) ** 2 for c in (1, 2, 3)) <= r * r}
        assert got == near(2.5) and got5 == near(5.0) and got and got5


def test_pair_join_is_an_equi_join(spark):
    plan = P.within_radius(frame_of(spark, cloud(20)), 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in plan and "Cross" not in plan


def blocks_and_pairs(spark):
    s = S.by_frame_windows(frame_of(spark, cloud(150)), 1)
    return E.PairBlocks(P.within_radius(s.assign, 40.0, ("segment",)), 6), P.within_radius(s.assign, 40.0, ("segment",))


def test_block_path_equals_sql_path_and_finite_differences(spark):
    blocks, pairs = blocks_and_pairs(spark)
    mu = np.random.default_rng(2).normal(0, 5, (6, 3))
    table = spark.createDataFrame([(k, *map(float, m)) for k, m in enumerate(mu)], "segment int, dx double, dy double, dz double")
    value, g = blocks.objective(9.0)(mu.ravel())
    assert value == pytest.approx(C.cost(pairs, table, C.gaussian(9.0)).first()["cost"])
    sql = {r.segment: (r.gx, r.gy, r.gz) for r in C.gradient(pairs, table, C.gaussian(9.0)).collect()}
    assert g.reshape(6, 3) == pytest.approx(np.array([sql[k] for k in range(6)]), abs=1e-12)
    blocks.local = None  # the distributed evaluation
    job, h = blocks.objective(9.0)(mu.ravel())
    assert job == pytest.approx(value) and h == pytest.approx(g)
    blocks.local = [E.Block(b) for b in blocks.blocks.toArrow().column("block").to_pylist()]
    f = blocks.objective(9.0)
    for k in (0, 7, 17):
        d = np.zeros(18)
        d[k] = 1e-5
        assert (f(mu.ravel() + d)[0] - f(mu.ravel() - d)[0]) / 2e-5 == pytest.approx(g[k], abs=1e-7)
    assert g.reshape(6, 3).sum(0) == pytest.approx(0, abs=1e-12)
    assert f(mu.ravel() + 3.0)[0] == pytest.approx(value)  # a shift of all segments changes nothing


def test_no_pairs_cost_nothing(spark):
    none = P.within_radius(S.by_frame_windows(frame_of(spark, []), 1).assign, 1.0, ("segment",))
    mu = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "segment int, dx double, dy double, dz double")
    assert C.cost(none, mu, C.gaussian(1.0)).first()["cost"] == 0
    assert C.gradient(none, mu, C.gaussian(1.0)).count() == 0


def test_plain_kernel_is_the_other_sign(spark):
    _, pairs = blocks_and_pairs(spark)
    mu = spark.createDataFrame([(k, math.sin(k), k * 0.5, 0.0) for k in range(6)], "segment int, dx double, dy double, dz double")
    minus = mu.select("segment", *((-F.col(c)).alias(c) for c in ("dx", "dy", "dz")))
    a = {r.segment: r for r in C.gradient(pairs, mu, C.gaussian(5.0)).collect()}
    b = {r.segment: r for r in C.gradient(pairs, minus, C.plain(100.0)).collect()}
    for k in a:
        assert a[k].gx * 5.0 == pytest.approx(-b[k].gx)


def test_minimiser_keeps_to_its_bounds():
    centre = np.array([0.3, 9.0, -9.0])
    x, value, good, _ = lbfgsb(lambda v: (float(((v - centre) ** 2).sum()), 2 * (v - centre)), np.zeros(3), 2.0)
    assert good and x == pytest.approx([0.3, 2.0, -2.0], abs=1e-5)


def test_minimiser_on_a_valley():
    def f(v):
        a, b = v
        return float((1 - a) ** 2 + 100 * (b - a * a) ** 2), np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, _, good, _ = lbfgsb(f, np.array([-1.2, 1.0]), 10.0)
    assert good and x == pytest.approx([1, 1], abs=1e-3)


def test_anneal_gives_up_after_six_failures():
    calls = []

    def broken(sigma):
        calls.append(sigma)
        return lambda v: (float("nan"), np.ones_like(v))

    with pytest.raises(RuntimeError):
        anneal(broken, 2, 10.0, 1.0, 5.0)
    assert len(calls) == 6 and calls[-1] > calls[0]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7])
def test_boxcar_mirrors(width):
    x = np.arange(5, dtype=float)[:, None]
    padded = np.concatenate([x[::-1], x, x[::-1], x])
    lo = -((width - 1) // 2)
    want = np.array([padded[5 + i + lo : 5 + i + lo + width].mean() for i in range(5)])[:, None]
    assert reflect_boxcar(x, width) == pytest.approx(want)


def test_boxcar_of_no_width():
    with pytest.raises(ValueError):
        reflect_boxcar(np.zeros((3, 1)), 0)


@settings(deadline=None, max_examples=30)
@given(st.lists(st.floats(-5, 5), min_size=4, max_size=4), st.integers(4, 9))
def test_not_a_knot_gives_cubics_back(c, n):
    x = np.cumsum(np.linspace(1, 2, n))
    f = lambda v: c[0] + c[1] * v + c[2] * v**2 + c[3] * v**3
    at = np.linspace(x[0] - 1, x[-1] + 1, 17)
    got = spline.evaluate(*spline.pieces(x, f(x)[:, None]), at)[:, 0]
    assert got == pytest.approx(f(at), rel=1e-6, abs=1e-5)


def test_short_splines():
    at = np.array([-1.0, 0.5, 3.0])
    assert spline.evaluate(*spline.pieces([1.0], [[4.0]]), at)[:, 0] == pytest.approx([4, 4, 4])
    assert spline.evaluate(*spline.pieces([0.0, 2.0], [[0.0], [4.0]]), at)[:, 0] == pytest.approx(2 * at)
    assert spline.evaluate(*spline.pieces([0.0, 1.0, 3.0], [[0.0], [1.0], [9.0]]), at)[:, 0] == pytest.approx(at**2)


def test_natural_spline_goes_on_straight(spark):
    x, y = np.array([1.0, 3.0, 4.0, 8.0]), np.array([[0.0], [2.0], [-1.0], [5.0]])
    start, c = spline.pieces(x, y, natural=True, straight_ends=True)
    inner = spline.evaluate(start, c, x)[:, 0]
    assert inner == pytest.approx(y[:, 0])
    out = spline.evaluate(start, c, np.array([8.0, 9.0, 10.0, -1.0, 0.0, 1.0]))[:, 0]
    assert out[2] - out[1] == pytest.approx(out[1] - out[0]) and out[5] - out[4] == pytest.approx(out[4] - out[3])


def test_spline_on_executors_equals_the_driver(spark):
    centers, mu = np.array([2.0, 5.5, 9.0, 14.0]), np.random.default_rng(0).normal(size=(4, 3))
    for method in ("cubic", "natural"):
        got = E.interpolate(D.frame_axis(spark, 17), centers, mu, method).orderBy("frame").collect()
        start, c = spline.pieces(centers, mu, method == "natural", method == "natural")
        assert np.array([r[1:] for r in got]) == pytest.approx(spline.evaluate(start, c, np.arange(18)))
    with pytest.raises(ValueError):
        E.interpolate(D.frame_axis(spark, 3), centers, mu, "nothing")


def test_catmull_rom_needs_four_knots(spark):
    knots = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (2.0, 2.0, 2.0, 2.0), (3.0, 3.0, 3.0, 3.0)], "center_frame double, dx double, dy double, dz double")
    assert {r.dx for r in D.catmull_rom(D.frame_axis(spark, 5), knots).collect()} == {0.0}
    line = spark.createDataFrame([(float(k), k + 0.5, 0.0, 0.0) for k in range(6)], "center_frame double, dx double, dy double, dz double")
    got = [r.dx for r in D.catmull_rom(D.frame_axis(spark, 6), line).orderBy("frame").collect()]
    assert got == pytest.approx([0, 1.5, 2.5, 3.5, 4.5, 0, 0])
    assert [r.dx for r in D.catmull_rom(D.frame_axis(spark, 6), line, whole_numbers=True).orderBy("frame").collect()] == [0, 1, 2, 3, 4, 0, 0]


def test_apply_refuses_frames_without_drift(spark):
    locs, drift = frame_of(spark, [(1, 0.0, 0.0, 0.0, 3)]), spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "frame int, dx double, dy double, dz double")
    with pytest.raises(Exception, match="no drift for frame 3"):
        D.apply(locs, drift).collect()


def test_recovery(spark):
    """Known drift comes back within a nanometre."""
    locs, truth = synthetic.sites_in_cube(spark, 600, 60, 100), synthetic.waveform(spark, 60)
    result = E.estimate_drift(locs, DriftConfig(2, 2, None, 120, 100, 10))
    assert M.error(result.drift_frames, truth).first()["error"] < 1.0
    moved = result.corrected.filter("frame = 30").count()
    assert moved == 100 and result.trace.count() == len(result.trace.collect())


def test_refuses_too_many_pairs_and_too_small_sigma(spark):
    locs = frame_of(spark, cloud(80))
    with pytest.raises(ValueError, match="pairs"):
        E.estimate_drift(locs, DriftConfig(2, 1, max_pairs=10))
    assert DriftConfig().max_pairs is None  # opt-in
    with pytest.raises(ValueError, match="sigma"):
        E.estimate_drift(locs, DriftConfig(2, 1, max_drift_nm=2))
    with pytest.raises(ValueError, match="no segment"):
        E.estimate_drift(locs, DriftConfig(1, 1000))


def test_estimates_on_executors_and_driver_agree(spark, tmp_path):
    locs = synthetic.sites_in_cube(spark, 100, 16, 60)
    cfg = DriftConfig(2, 2, None, 60, 100, 30)
    here = E.estimate_drift(locs, cfg, rounds_to=str(tmp_path / "rounds"))
    there = E.estimate_drift(locs, replace(cfg, local_bytes=0))
    values = lambda r: np.array([x[2:] for x in r.drift_segments.orderBy("segment").collect()])
    assert np.array_equal(values(there), values(here))  # to the bit
    rounds = spark.read.parquet(str(tmp_path / "rounds"))
    assert rounds.select("iteration").distinct().count() == here.trace.count() and rounds.count() == 8 * here.trace.count()


def merging(monkeypatch, chunk=2000):
    monkeypatch.setattr(X, "CHUNK", chunk)
    return X.Grid(6.0, 100.0, 4)


def some_pairs(spark, n, copies=1, spread=0.1):
    r = np.random.default_rng(4)
    d = np.where(r.random((n, 1)) < spread, r.uniform(-50, 50, (n, 3)), r.normal(0, 3, (n, 3)))
    rows = [(int(i), int(j), *map(float, v)) for i, j, v in zip(r.integers(0, 4, n), r.integers(0, 4, n), d, strict=True)]
    return spark.createDataFrame(rows, "segment_i int, segment_j int, dx0 double, dy0 double, dz0 double").crossJoin(spark.range(copies)).drop("id")


@pytest.mark.parametrize("local", [1 << 30, 0])
def test_merged_pairs_give_the_same_sums(spark, local, monkeypatch):
    """Every pair counts, at widths above the cells' size and, with finer cells, below it."""
    pairs, mu = some_pairs(spark, 9000).repartition(3), np.random.default_rng(2).normal(0, 4, 12)
    plain, merged = E.PairBlocks(pairs, 4), E.PairBlocks(pairs, 4, local, merging(monkeypatch))
    assert merged.n_pairs == plain.n_pairs == 9000 and merged.blocks.filter("cells").count() and merged.blocks.filter("NOT cells").count()
    coarse = np.array([0, 0, 1, 1])
    for sigma in (100.0, 12.0, 6.0, 4.0):
        for relabel, n in ((None, 4), (coarse, 2)):
            (c, g), (d, h) = (b.objective(sigma, relabel, n)(mu[: 3 * n]) for b in (plain, merged))
            assert d == pytest.approx(c, rel=1e-9) and h == pytest.approx(g, abs=1e-8 * abs(c))
    assert merged.grid.size == 2.0 and merged.n_pairs == 9000
    merged.release()


def test_merged_pairs_do_not_grow_with_the_localizations(spark, monkeypatch):
    grid, held = merging(monkeypatch), []
    for copies in (80, 160):  # every cell that is there has pairs enough
        b = E.PairBlocks(some_pairs(spark, 4000, copies, 0.0), 4, 0, grid)
        assert b.n_pairs == 4000 * copies
        held.append(b.held_bytes)
        b.release()
    assert held[1] == held[0] < 320_000 * E.PAIR_BYTES / 10


@pytest.mark.parametrize("span", [1, 1 << 15, 1 << 20, 1 << 40, 1 << 55])
def test_pairs_of_small_cells_stay_in_the_order_they_came(span):
    grid, rng = X.Grid(4.0, 20.0, 3), np.random.default_rng(5)
    keys = 7 + span * rng.integers(0, 200, 6000)
    held = X.Merger(grid)
    held.add_pairs(keys, np.stack([np.arange(6000.0)] * 3))
    whole, _, few, d = held.taken(last=True)
    assert not whole.size and (np.diff(few) >= 0).all()
    assert (np.diff(d[0])[np.diff(few) == 0] > 0).all() and (keys[d[0].astype(int)] == few).all()


def test_moments_over_many_turns_are_the_plain_sums():
    """Cells of some pairs and of more than a turn takes, against numpy's own polynomials."""
    grid, rng = X.Grid(4.0, 20.0, 3), np.random.default_rng(6)
    many = np.array([90, 700, 3 * X.TURN + 5, 80, X.TURN, 74])
    middles = np.array([[2.0, 2.0, -6.0], [6.0, -2.0, 2.0], [10.0, 10.0, 10.0], [-2.0, 6.0, 14.0], [14.0, 2.0, 2.0], [-10.0, -10.0, 6.0]])
    t = rng.uniform(-0.999, 0.999, (3, many.sum()))
    d = np.repeat(middles, many, axis=0).T + 2.0 * t
    keys = grid.keys(np.zeros(many.sum(), int), np.ones(many.sum(), int), d)
    first = np.cumsum(many) - many
    got = X.moments(keys, first, d, grid)
    x, y, z = (np.polynomial.chebyshev.chebvander(v, X.DEGREE) for v in t)
    plain = np.add.reduceat(x[:, X._KA] * y[:, X._KB] * z[:, X._KC], first, axis=0)
    assert (got[:, 0] == many).all() and np.abs(got - plain).max() < 1e-9


def pairs_of_chunks(locs, radius):
    out = [p for b in P.chunks_within(locs, radius).toArrow().to_batches(max_chunksize=40) if b.num_rows for p in P.pairs_met(b, radius)]
    return sorted((*((i, j) if i <= j else (j, i)), *np.round(np.abs(v), 9)) for a, b, d in out for i, j, v in zip(a.tolist(), b.tolist(), d.T.tolist(), strict=True))


@pytest.mark.parametrize("size,radius,tested", [(60.0, 25.0, 1 << 18), (60.0, 25.0, 100), (400.0, 60.0, 1 << 18), (10.0, 100.0, 5000)])
def test_chunks_make_up_the_same_pairs(spark, size, radius, tested, monkeypatch):
    """Each pair once: over the edges of cells, in cells of many chunks, of rows at one place, and none of rows without place."""
    monkeypatch.setattr(P, "TESTED", tested)
    at = 2 * radius * (1 + 2 * P.MARGIN)
    rows = [*cloud(500, size=size), *((600 + k, k % 3 * at, -at, 0.0, k % 4) for k in range(9))]
    rows += [(700, 0.0, 0.0, 0.0, 1), (701, float("nan"), 0.0, 0.0, 1), (702, float("inf"), 0.0, 0.0, 1), (703, 0.0, 0.0, float("nan"), 2)]
    locs = P.numbered(frame_of(spark, rows).repartition(3).withColumns({"segment": F.col("frame"), "x": F.when(F.col("loc_id") != 700, F.col("x"))}))
    want = P.within_radius(locs, radius, ("segment",)).select("segment_i", "segment_j", "dx0", "dy0", "dz0").collect()
    want = sorted((*sorted(r[:2]), *np.round(np.abs(r[2:]), 9)) for r in want)
    got = pairs_of_chunks(locs, radius)
    assert len(got) == len(want) > 100 and got == want


def test_no_chunks_no_pairs(spark):
    locs = P.numbered(frame_of(spark, []).withColumn("segment", F.col("frame")))
    assert pairs_of_chunks(locs, 10.0) == []


def test_merged_pairs_are_no_rows_of_a_table(spark, monkeypatch):
    """What meets in the join is chunks; the pairs are made where they are merged."""
    monkeypatch.setattr(E, "MERGED", 1)
    locs = synthetic.sites_in_cube(spark, 20, 40, 40)
    _, _, blocks, _ = E._prepared(locs, DriftConfig(2, 10, None, 120, 100, 10), None)
    n = P.within_radius(locs, 100.0).count()
    assert blocks.n_pairs == n and blocks.chunks.count() * 20 < n
    blocks.release()


def test_an_estimate_over_merged_pairs_is_the_same(spark, monkeypatch):
    locs, truth = synthetic.sites_in_cube(spark, 40, 60, 40), synthetic.waveform(spark, 60)
    cfg = DriftConfig(2, 10, None, 120, 100, 10)
    plain = E.estimate_drift(locs, cfg)
    monkeypatch.setattr(E, "MERGED", 1)
    merged = E.estimate_drift(locs, cfg)
    assert M.error(plain.drift_frames, truth).first()["error"] < 5 and merged.params["n_pairs"] == plain.params["n_pairs"]
    assert M.mean_distance(plain.drift_frames, merged.drift_frames).first()["mean_distance"] < 1e-6


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_sums_do_not_depend_on_partitions(spark, parts, monkeypatch):
    """Cost and gradient to the bit: on the driver, on executors, added up by segment or not, relabelled or not."""
    r = np.random.default_rng(1)
    rows = [(int(i), int(j), *map(float, d)) for i, j, d in zip(r.integers(0, 9, 3000), r.integers(0, 9, 3000), r.normal(0, 20, (3000, 3)), strict=True)]
    pairs = spark.createDataFrame(rows, "segment_i int, segment_j int, dx0 double, dy0 double, dz0 double")
    mu, coarse = r.normal(0, 5, 27), np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])
    want = E.PairBlocks(pairs.coalesce(1), 9)
    got = []
    for local, few in ((1 << 20, 200_000), (0, 200_000), (0, 0)):
        monkeypatch.setattr(E.PairBlocks, "FEW", few)
        b = E.PairBlocks(pairs.repartition(parts), 9, local)
        assert (b.local is not None) == (local > 0) and b.n_pairs == 3000
        got += [(b.objective(8.0)(mu), want.objective(8.0)(mu)), (b.objective(8.0, coarse, 3)(mu[:9]), want.objective(8.0, coarse, 3)(mu[:9]))]
        b.release()
    for (c, g), (d, h) in got:
        assert c == d and np.array_equal(g, h)
    e = np.array([x[2:] for x in rows]) - (mu.reshape(9, 3)[[x[0] for x in rows]] - mu.reshape(9, 3)[[x[1] for x in rows]])
    assert got[0][0][0] == pytest.approx(-np.exp(-(e * e).sum(1) / 256).sum() / 8, rel=1e-12)


def test_bounded_minimiser_where_bounds_are_active():
    """Chained valleys with the bottom outside of the bounds: the same place as by plain projected steps, in fewer calls."""

    def valleys(v):
        x, y = v[:-1], v[1:]
        g = np.zeros_like(v)
        g[:-1] = -400 * x * (y - x * x) - 2 * (1 - x)
        g[1:] += 200 * (y - x * x)
        return float((100 * (y - x * x) ** 2 + (1 - x) ** 2).sum()), g

    for n in (2, 10, 50):
        x, v, good, calls = lbfgsb(valleys, np.full(n, -1.2), 0.5)
        p, w, _, more = projected(valleys, np.full(n, -1.2), 0.5)
        assert good and calls < more / 2 and v <= w + 1e-9 and np.abs(x).max() <= 0.5 and x == pytest.approx(p, abs=1e-3)
    x, v, good, _ = lbfgsb(valleys, np.full(30, -1.2), 10.0)
    assert good and x == pytest.approx(np.ones(30), abs=1e-3)
    assert lbfgsb(lambda v: (0.0, np.zeros_like(v)), np.ones(3), 2.0)[2:] == (True, 1)  # flat
    assert lbfgsb(lambda v: (float(-v.sum()), -np.ones_like(v)), np.zeros(4), 3.0)[0] == pytest.approx(np.full(4, 3.0))


def test_steps_meet_the_strong_wolfe_conditions():
    for f, h in ((lambda t: -t / (t * t + 2), lambda t: (t * t - 2) / (t * t + 2) ** 2), (lambda t: (t - 3) ** 4, lambda t: 4 * (t - 3) ** 3), (lambda t: np.cos(t) + t * t / 50, lambda t: -np.sin(t) + t / 25 - 1e-3)):
        for first in (1e-3, 0.1, 1.0, 10.0, 100.0):
            if not h(0.0) < 0:
                continue
            step = strong_wolfe(lambda t: (float(f(t)), float(h(t))), float(f(0.0)), float(h(0.0)), first, 1e10, flat=0.1)  # noqa: B023
            assert step is not None and f(step) <= f(0.0) + 1e-3 * step * h(0.0) + 1e-12 and abs(h(step)) <= 0.1 * abs(h(0.0)) + 1e-12


def test_whole_inverse_hessian_in_a_valley():
    def f(v):
        a, b = v
        return float((1 - a) ** 2 + 100 * (b - a * a) ** 2), np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, v, good, calls = dfp(f, np.array([-1.2, 1.0]))
    assert good and x == pytest.approx([1, 1], abs=1e-6) and calls < 60
    with pytest.raises(ValueError, match="too large"):
        dfp(f, np.zeros(5), largest=4)


def test_rounds_of_the_whole_inverse_hessian_do_not_grow_with_the_cost():
    """A cost below 0 of any size, as pairs add it up, with the rounding of its size."""
    centre = np.linspace(-40, 40, 30)

    def cost(size):
        def f(v):
            w = size * np.exp(-((v - centre) ** 2) / 1e4)
            return -float(w.sum()), np.rint(2e-4 * w * (v - centre) / (size * 1e-15)) * (size * 1e-15)

        return f

    small, large = (dfp(cost(size), np.zeros(30)) for size in (1e2, 1e8))
    assert small[2] and large[2] and large[0] == pytest.approx(centre, abs=1e-2)
    assert small[3] < 30 and large[3] < 100


def test_unbounded_minimiser_and_one_level():
    centre = np.array([0.3, 9.0, -9.0])
    bowl = lambda v: (float(((v - centre) ** 2).sum()), 2 * (v - centre))
    x, _, good, calls = optimized(bowl, np.zeros(3), 2.0, "bfgs")
    assert good and x == pytest.approx(centre, abs=1e-5) and calls < 100
    assert one_level(bowl, np.zeros((1, 3)), 5.0) == pytest.approx(np.array([[0.3, 5.0, -5.0]]), abs=1e-5)
    with pytest.raises(ValueError):
        optimized(bowl, np.zeros(3), 2.0, "newton")


def test_restart_from_no_drift_after_the_second_failure():
    seen = []

    def broken(sigma):
        def f(v):
            seen.append((sigma, v.copy()))
            return float("nan"), np.ones_like(v)

        return f

    mu, trace = anneal(broken, 2, 10.0, 1.0, 5.0, start=np.ones((2, 3)), on_failure="restart")
    assert len(trace) == 6 and not any(t["good"] for t in trace) and mu == pytest.approx(0)
    first = [v for s, v in seen if s == 10.0]
    assert first and first[0] == pytest.approx(1) and {s for s, _ in seen} == {10.0, 20.0}


def test_spline_needs_four_segments(spark):
    few, more = (np.array([1.0, 4.0, 6.0, 9.0])[:n] for n in (3, 4))
    mu = np.array([[0.0] * 3, [4.0] * 3, [1.0] * 3, [2.0] * 3])
    at = lambda c, m: [r[1:] for r in E.interpolate(D.frame_axis(spark, 9), c, mu[: len(c)], m).orderBy("frame").collect()]
    assert at(few, "spline") == at(few, "linear") and at(more, "spline") == at(more, "cubic")


def test_hdf5_is_refused_with_the_way_out(spark):
    with pytest.raises(ValueError, match="Parquet"):
        readers.read(spark, "table.h5")


def test_one_segment_is_a_constant(spark):
    with pytest.warns(UserWarning):
        result = E.estimate_drift(frame_of(spark, cloud(40)), DriftConfig(2, 100, max_drift_nm=30))
    assert result.drift_frames.select("dx").distinct().count() == 1


def test_csv_round_trip(spark, tmp_path):
    locs = frame_of(spark, [(k, k * 1.5, -k * 2.25, float(k % 2), k % 4) for k in range(20)])
    sinks.write_thunderstorm(locs, str(tmp_path / "a.csv"))
    text = "".join(p.read_text() for p in (tmp_path / "a.csv").glob("part*"))
    assert text.splitlines()[0] == '"id","frame","x [nm]","y [nm]","z [nm]"' and '3,3,4.500,-6.750,1.000' in text
    back = readers.read(spark, str(tmp_path / "a.csv"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in locs.collect()}
    with pytest.raises(FileNotFoundError):
        readers.read_thunderstorm(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError):
        readers.read(spark, "x.txt")


def test_exported_ids_follow_each_other(spark, tmp_path):
    """0 to n - 1 over all part files, in order of loc_id, whatever the ids were."""
    from plumbline.operators import ordered

    locs = frame_of(spark, [(k * k * 10_000_000_000, float(k), 0.0, 0.0, k) for k in range(50)]).repartition(5)
    size, ordered.SIZE = ordered.SIZE, 10
    try:
        sinks.write_thunderstorm(locs, str(tmp_path / "t.csv"), single=False)
        sinks.write_molecule_set(locs, str(tmp_path / "m.parquet"), 1.0, swap_axes=False)
    finally:
        ordered.SIZE = size
    files = sorted((tmp_path / "t.csv").glob("part*"))
    lines = [x for f in files for x in f.read_text().splitlines()[1:]]
    assert len(files) > 2 and [x.split(",")[:2] for x in lines] == [[str(k), str(k)] for k in range(50)]
    assert {(r.INDEX, r.FRAME_NUMBER) for r in spark.read.parquet(str(tmp_path / "m.parquet/datatable")).collect()} == {(k, k) for k in range(50)}


def test_command_line_on_several_files_without_ids(spark, tmp_path):
    from plumbline.cli import main

    locs = synthetic.sites_in_cube(spark, 200, 8, 40).repartition(3)
    locs.select("frame", F.col("x").alias("x [nm]"), F.col("y").alias("y [nm]"), F.col("z").alias("z [nm]")).write.option("header", True).csv(str(tmp_path / "in.csv"))
    main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out.parquet"), "-sv", "2", "-isig", "60", "--format", "parquet"], spark)
    table = spark.read.parquet(str(tmp_path / "out.parquet/datatable"))
    assert sorted(r.INDEX for r in table.collect()) == list(range(320))


def test_molecule_set_round_trip(spark, tmp_path):
    locs = frame_of(spark, cloud(20))
    sinks.write_molecule_set(locs, str(tmp_path / "m.parquet"), 160.0, swap_axes=False)
    back = {r.loc_id: r for r in readers.read(spark, str(tmp_path / "m.parquet")).collect()}
    for r in locs.collect():
        assert back[r.loc_id].x == pytest.approx(r.x, abs=1e-3) and back[r.loc_id].frame == r.frame
    with pytest.raises(KeyError):
        readers.pixel_sizes({})
    assert readers.pixel_sizes({"pixel_size_um": 0.1, "xy_pixel_size_um": 1, "z_pixel_size_um": 1}) == (100.0, 100.0)
    few = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "PHOTONS double")
    assert readers.bandpass(few, (1.0, 3.0)).count() == 1 and readers.bandpass(few, (1.0, None)).count() == 3


def test_command_line_and_details(spark, tmp_path):
    from plumbline.cli import main

    locs = synthetic.sites_in_cube(spark, 300, 12, 60)
    sinks.write_thunderstorm(locs, str(tmp_path / "in.csv"))
    main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out.csv"), "-sv", "2", "-isig", "60", "--format", "csv"], spark)
    assert readers.read_csv_all(spark, str(tmp_path / "out.csv")).count() == 720
    result = E.estimate_drift(locs, DriftConfig(2, 2, None, 60, 100, 10))
    sinks.write_details(result, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/drift_segments")).count() == 6
    sinks.write_intermediate(result.drift_segments.withColumn("iteration", F.lit(1)), str(tmp_path / "i"))
    sinks.write_drift_csv(result.drift_frames, str(tmp_path / "f.csv"))
    sinks.write_custom(result.drift_frames, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 12


def test_stream_is_corrected(spark, tmp_path):
    from plumbline.streaming.apply import corrected_stream, read_stream, write_stream

    frame_of(spark, cloud(30)).write.parquet(str(tmp_path / "in"))
    drift = spark.createDataFrame([(f, 1.0, 2.0, 3.0) for f in range(6)], "frame int, dx double, dy double, dz double")
    q = write_stream(corrected_stream(read_stream(spark, str(tmp_path / "in")), drift), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("x")).first()[0] == pytest.approx(sum(r[1] - 1 for r in cloud(30)))


def test_written_tables_go_when_nothing_refers_to_them(spark):
    import gc
    import time
    from pathlib import Path

    from plumbline.sources.scratch import cut, scratch

    folder = Path(scratch(spark).removeprefix("file:"))
    held, gone = cut(spark.range(10)), cut(spark.range(20))
    files = lambda: {p.name for p in folder.glob("rdd-*") if any(p.iterdir())}
    before = files()
    used = held.selectExpr("id + 1 AS k")
    del held, gone
    for _ in range(50):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        if len(files()) < len(before):
            break
    assert len(files()) < len(before) and used.agg(F.sum("k")).first()[0] == 55
