"""The whole estimate: segments, pairs, annealed minimisation, interpolation, correction.

Pairs are searched once, reduced to what the cost needs of them (two segments and a difference of positions), packed
into binary blocks, written to the shared checkpoint folder and held on the executors. An evaluation is one job over the
blocks: the drift of the segments goes out, partial sums per segment come back. Only where all blocks together are within
``DriftConfig.local_bytes`` (some MB, checked) are they evaluated on the driver, which saves a job per evaluation.

From ``MERGED`` pairs on, those of like segments and differences are merged into moments (``operators/moments.py``), first
in the task that finds them, then by cell. The cells that there can be do not grow with the localizations, and so neither
do the blocks nor an evaluation of them. Where a width falls below the cells' size, finer cells are made of all pairs.

Sums do not depend on how pairs are dealt: what a pair adds is rounded to a whole number of units, which are chosen so
that the sum of all pairs fits into 62 bits, and whole numbers add up to the same in every order. So an estimate is the
same, bit for bit, on the driver and on executors, and at every number of partitions. (Moments are sums of floats: merged
pairs give the same at every dealing but for the last digits of these.)
"""

from __future__ import annotations

import math
import os
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spline import evaluate, pieces
from ..operators import drift as D
from ..operators.moments import Cells, Grid, Merger
from ..operators.pairs import estimate as pair_estimate
from ..operators.pairs import _ROW, chunks_within, expected, numbered, pairs_met, within_radius
from ..operators.segment import Segmentation, _described, ladder, segment, statistics
from ..schema import DRIFT, DriftConfig
from ..sources.scratch import cut

#: Pairs in a block, and bytes of a pair in it: three differences. (Segments are told once for each run of pairs.)
BLOCK, PAIR_BYTES = 1 << 17, 24
_BLOCKS = "block binary, n long, cells boolean"
#: An estimate of pairs beyond which a run warns before it begins.
MANY_PAIRS = 250_000_000
#: An estimate of pairs (``pairs.estimate``, which counts them both ways) from which they are merged.
MERGED = 20_000_000


def _plain(i, j, *d) -> bytes:
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    runs = (i[first], j[first], np.diff(np.append(first, i.size)), np.array([first.size]))
    return b"".join([*(x[order].astype("<f8").tobytes() for x in d), *(x.astype("<i4").tobytes() for x in runs)])


def _block(data: bytes, n: int, cells: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([n]), pa.array([cells])], names=["block", "n", "cells"])


def _pack(batches):
    """Rows (segment_i, segment_j, dx0, dy0, dz0) as binary blocks, in order of the segments: the differences, axis by
    axis, then the segments and length of each run of a pair of segments, and how many runs there are.
    """
    held, n = [], 0

    def block():
        rows = pa.Table.from_batches(held).combine_chunks()
        return _block(_plain(*(rows.column(k).to_numpy() for k in range(5))), rows.num_rows, False)

    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(lo, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _merged(pairs: DataFrame, grid: Grid) -> DataFrame:
    """Pairs (segment_i, segment_j, dx0, dy0, dz0), or chunks that make them up (``chunks_within`` of the grid's radius),
    as blocks of cells, and of pairs where a cell has few.
    """
    in_chunks = "same" in pairs.columns

    def first(batches):
        held = Merger(grid)
        for batch in batches:
            for i, j, d in pairs_met(batch, grid.radius) if in_chunks else [pair_rows(batch)]:
                d = np.where(i > j, -1.0, 1.0) * d  # either way round is the same pair
                i, j = np.minimum(i, j), np.maximum(i, j)
                held.add_pairs(grid.keys(i, j, d), d)
                yield from rows(held.taken())
        yield from rows(held.taken(last=True))

    def pair_rows(batch):
        i, j, *d = (c.to_numpy() for c in batch.columns)
        return i, j, np.stack(d)

    def rows(got):
        if got is None:
            return
        keys, sums, few, d = got
        for lo in range(0, keys.size, 4096):
            part = sums[lo : lo + 4096]
            none = pa.nulls(len(part), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 4096]), none, none, none, pa.array([m.tobytes() for m in part], pa.binary())], names=names)
        if few.size:
            yield pa.RecordBatch.from_arrays([pa.array(few), *map(pa.array, d), pa.nulls(few.size, pa.binary())], names=names)

    def second(batches):
        held = Merger(grid)
        for batch in batches:
            whole = np.asarray(batch.column("sums").is_valid())
            keys = batch.column("key").to_numpy()
            if whole.any():
                held.add_moments(keys[whole], np.frombuffer(b"".join(batch.column("sums").drop_null().to_pylist())).reshape(int(whole.sum()), -1))
            if not whole.all():
                held.add_pairs(keys[~whole], np.stack([batch.column(c).to_numpy(zero_copy_only=False)[~whole] for c in names[1:4]]))
            yield from blocks(held.taken())
        yield from blocks(held.taken(last=True))

    def blocks(got):
        if got is None:
            return
        keys, sums, few, d = got
        for lo in range(0, keys.size, 2048):
            part = sums[lo : lo + 2048]
            yield _block(Cells.packed(keys[lo : lo + 2048], part), int(np.rint(part[:, 0]).sum()), True)
        i, j, _ = grid.places(few)
        for lo in range(0, few.size, BLOCK):
            at = slice(lo, lo + BLOCK)
            yield _block(_plain(i[at], j[at], *(x[at] for x in d)), few[at].size, False)

    names = ["key", "dx0", "dy0", "dz0", "sums"]
    found = pairs.mapInArrow(first, "key long, dx0 double, dy0 double, dz0 double, sums binary")
    return found.repartition("key").mapInArrow(second, _BLOCKS)


class Block:
    """The pairs of one block: where each pair of segments begins, its two segments, and the differences."""

    def __init__(self, data: bytes):
        size = memoryview(data).nbytes
        n = int(np.frombuffer(data, "<i4", 1, size - 4)[0])
        self.i, self.j, self.many = np.frombuffer(data, "<i4", 3 * n, size - 12 * n - 4).reshape(3, n)
        self.first = np.cumsum(self.many) - self.many
        self.d = np.frombuffer(data, "<f8", (size - 12 * n - 4) // 8).reshape(3, -1)


@dataclass(frozen=True)
class Kernel:
    """The Gaussian at one width, and the units of cost and gradient for so many pairs."""

    sigma: float
    n_pairs: int

    @property
    def scale(self) -> float:
        return 4.0 * self.sigma * self.sigma

    @property
    def norm(self) -> float:
        return 1.0 / self.sigma

    def _unit(self, most: float) -> float:
        """A power of two: as many pairs of ``most`` each, in units of it, stay under 2**61."""
        return 2.0 ** (math.ceil(math.log2(most * max(1, self.n_pairs))) - 61)

    @property
    def cost_unit(self) -> float:
        return self._unit(self.norm)

    @property
    def gradient_unit(self) -> float:
        # |e| exp(-|e|^2 / scale) is largest where |e|^2 = scale / 2
        return self._unit(2.0 * self.norm / self.scale * math.sqrt(self.scale / 2.0) * math.exp(-0.5))


def sums(pairs: Block | Cells, mu: np.ndarray, kernel: Kernel) -> tuple[int, np.ndarray]:
    """Cost and gradient of the pairs of one block, in units. The drift and the sums are taken per pair of segments."""
    if isinstance(pairs, Cells):
        return _cell_sums(pairs, mu, kernel)
    e = pairs.d - np.repeat((mu[pairs.i] - mu[pairs.j]).T, pairs.many, axis=1)
    w = np.exp(np.einsum("ij,ij->j", e, e) * (-1.0 / kernel.scale)) * kernel.norm
    g = np.zeros(mu.shape, np.int64)
    cost = -int(np.rint(w / kernel.cost_unit).astype(np.int64).sum())
    w *= 2.0 / kernel.scale / kernel.gradient_unit
    for k in range(3):
        v = np.add.reduceat(np.rint(w * e[k]).astype(np.int64), pairs.first)
        np.subtract.at(g[:, k], pairs.i, v)
        np.add.at(g[:, k], pairs.j, v)
    return cost, g


def _cell_sums(cells: Cells, mu: np.ndarray, kernel: Kernel) -> tuple[int, np.ndarray]:
    cost, g = 0, np.zeros(mu.shape, np.int64)
    for at, w, e in cells.weights(mu, kernel.scale):
        cost -= int(np.rint(w * (kernel.norm / kernel.cost_unit)).astype(np.int64).sum())
        v = np.rint(e.T * (kernel.norm * 2.0 / kernel.scale / kernel.gradient_unit)).astype(np.int64)
        np.subtract.at(g, cells.i[at], v)
        np.add.at(g, cells.j[at], v)
    return cost, g


def _opened(data, cells: bool, grid: Grid | None) -> Block | Cells:
    return Cells(data, grid) if cells else Block(data)


class PairBlocks:
    """The pairs of a run, ready to be evaluated again and again, until they are released.

    ``grid``: pairs are merged into moments of its cells, which serve every width from the cells' size on; ``chunks`` make
    up the same pairs, and are merged in their place.
    """

    #: Rows of partial sums that the driver takes as they are; more are added up by segment first.
    FEW = 200_000

    def __init__(self, pairs: DataFrame, segments: int, local_bytes: int = DriftConfig.local_bytes, grid: Grid | None = None, chunks: DataFrame | None = None):
        self.pairs, self.segments, self.local_bytes = pairs.select("segment_i", "segment_j", "dx0", "dy0", "dz0"), segments, local_bytes
        self.chunks = self.pairs if chunks is None else chunks
        self._make(grid)

    def _make(self, grid: Grid | None) -> None:
        self.grid = grid if grid is not None and grid.fits else None
        packed = self.pairs.mapInArrow(_pack, _BLOCKS) if self.grid is None else _merged(self.chunks, self.grid)
        self.blocks = cut(packed)
        size = F.when(F.col("cells"), F.octet_length("block")).otherwise(F.col("n") * PAIR_BYTES)
        counts = self.blocks.select("n", size.alias("size"), F.spark_partition_id().alias("part"))
        self.n_pairs, self.held_bytes, self.parts = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "size")), F.count_distinct("part")).first()
        self.local = None
        if self.held_bytes <= self.local_bytes:
            rows = self.blocks.toArrow()
            self.local = [_opened(b, c, self.grid) for b, c in zip(rows.column("block").to_pylist(), rows.column("cells").to_pylist(), strict=True)]
            self.threads = ThreadPoolExecutor(os.cpu_count())
        else:
            self.blocks = self.blocks.select("block", "cells").persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        if self.local is None:
            self.blocks.unpersist()
        else:
            self.threads.shutdown()

    def objective(self, sigma: float, relabel: np.ndarray | None = None, segments: int | None = None) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        """Cost and gradient at this width; ``relabel`` maps segments to coarser ones."""
        if self.grid is not None and sigma < self.grid.size:  # the series would not do: finer cells, from all pairs again
            self.release()
            self._make(replace(self.grid, size=sigma / 2.0))
        kernel, n = Kernel(sigma, self.n_pairs), segments or self.segments

        def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
            mu = flat.reshape(n, 3)
            fine = mu if relabel is None else mu[relabel]
            cost, g = self._here(fine, kernel) if self.local is not None else self._job(fine, kernel)
            if relabel is not None:
                coarse = np.zeros((n, 3), np.int64)
                np.add.at(coarse, relabel, g)
                g = coarse
            return cost * kernel.cost_unit, g.ravel() * kernel.gradient_unit

        return value

    def _here(self, mu: np.ndarray, kernel: Kernel) -> tuple[int, np.ndarray]:
        cost, g = 0, np.zeros(mu.shape, np.int64)
        for c, h in self.threads.map(lambda block: sums(block, mu, kernel), self.local):
            cost, g = cost + c, g + h
        return cost, g

    def _job(self, mu: np.ndarray, kernel: Kernel) -> tuple[int, np.ndarray]:
        held, grid = self.blocks.sparkSession.sparkContext.broadcast(mu), self.grid  # three numbers a segment

        def run(batches):
            cost, g = 0, np.zeros(held.value.shape, np.int64)
            for batch in batches:
                for b, cells in zip(batch.column("block"), batch.column("cells").to_pylist(), strict=True):
                    c, h = sums(_opened(b.as_buffer(), cells, grid), held.value, kernel)
                    cost, g = cost + c, g + h
            at = np.flatnonzero(g.any(1))
            arrays = [pa.array(np.append(at, -1)), pa.array(np.append(g[at, 0], cost)), *(pa.array(np.append(g[at, k], 0)) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(arrays, names=["segment", "gx", "gy", "gz"])

        got = self.blocks.select("block", "cells").mapInArrow(run, "segment long, gx long, gy long, gz long")
        if self.parts * (len(mu) + 1) > self.FEW:
            got = got.groupBy("segment").agg(*(F.sum(c).alias(c) for c in ("gx", "gy", "gz")))
        got = got.toArrow()
        held.destroy()
        s, v = got.column("segment").to_numpy(), np.stack([got.column(c).to_numpy() for c in ("gx", "gy", "gz")], 1)
        g = np.zeros(mu.shape, np.int64)
        np.add.at(g, s[s >= 0], v[s >= 0])
        return int(v[s < 0, 0].sum()), g


@dataclass
class DriftResult:
    segmentation: Segmentation
    drift_segments: DataFrame
    drift_frames: DataFrame
    corrected: DataFrame
    trace: DataFrame
    params: dict


def interpolate(frames: DataFrame, centers: np.ndarray, mu: np.ndarray, method: str) -> DataFrame:
    """Per-frame drift from per-segment drift: cubic, natural (straight beyond the ends), catmull-rom or linear; "spline" is
    cubic from four segments on and linear under that.
    """
    spark = frames.sparkSession
    if method == "spline":
        method = "cubic" if len(centers) >= 4 else "linear"
    if method in ("cubic", "natural"):
        if len(centers) == 1:
            warnings.warn("one segment: the drift is constant", stacklevel=2)
        start, c = pieces(centers, mu, natural=method == "natural", straight_ends=method == "natural" and len(centers) > 1)
        rows = [(float(s), *(float(v) for v in k.ravel())) for s, k in zip(start, c, strict=True)]
        table = spark.createDataFrame(rows, "center_frame double, " + ", ".join(f"{d}_c{k} double" for d in DRIFT for k in range(4)))
        return D.polynomial(frames, table)
    knots = spark.createDataFrame([(float(f), *map(float, m)) for f, m in zip(centers, mu, strict=True)], "center_frame double, dx double, dy double, dz double")
    if method in ("catmull-rom", "catmull_rom"):
        return D.catmull_rom(frames, knots)
    if method == "linear":
        return D.linear(frames, knots)
    raise ValueError(f"no interpolation called {method!r}")


def _prepared(locs: DataFrame, cfg: DriftConfig, segmentation: Segmentation | None):
    seg = segmentation or segment(locs, cfg.segmentation_var, cfg.segmentation_mode, cfg.max_locs_per_segment, seed=cfg.seed)
    rows = numbered(seg.assign)
    seg = Segmentation(rows.drop(_ROW), seg.segments, seg.params)
    table = (_described(rows, seg.params.get("min_n_locs_per_window", -1) != -1) if segmentation is None else seg.segments).orderBy("segment").toArrow()
    centers = np.array(table.column("center_frame").to_pylist(), float)
    if not len(centers):
        raise ValueError("no segment: there are too few localizations for the segmentation asked for")
    valid = rows.filter("valid")
    if cfg.max_pairs is not None:
        guess = expected(valid, cfg.max_drift_nm).first()
        if guess["n_pairs"] > cfg.max_pairs:
            raise ValueError(f"about {guess['n_pairs']:,} pairs ({guess['n_least']:,} to {guess['n_most']:,}), more than max_pairs {cfg.max_pairs:,}: lower max_drift_nm or max_locs_per_segment")
    dense = pair_estimate(valid, cfg.max_drift_nm).first()["n_pairs"]
    if dense > MANY_PAIRS:
        warnings.warn(f"about {dense:,} pairs: a lower max_drift_nm or max_locs_per_segment would be faster", stacklevel=3)
    # widths fall by 1.5 until they are at the target or below
    grid = Grid(cfg.target_sigma_nm / 1.5, cfg.max_drift_nm, len(centers)) if dense >= MERGED else None
    chunks = chunks_within(valid, cfg.max_drift_nm) if grid is not None and grid.fits else None
    blocks = PairBlocks(within_radius(valid, cfg.max_drift_nm, ("segment",)), len(centers), cfg.local_bytes, grid, chunks)
    return seg, centers, blocks, statistics(seg).first().asDict()


def estimate_drift(locs: DataFrame, cfg: DriftConfig = DriftConfig(), segmentation: Segmentation | None = None, rounds_to: str | None = None) -> DriftResult:
    """The drift of every frame from 0 to the last, and the localizations without it.

    ``rounds_to``: a folder to which every round of the optimizer adds its drift, as it ends.
    """
    from ..sources.sinks import write_intermediate
    from .optimize import anneal

    spark, sigma0 = locs.sparkSession, cfg.sigma0
    seg, centers, blocks, params = _prepared(locs, cfg, segmentation)

    def keep(step: dict, mu: np.ndarray) -> None:
        rows = [(step["iteration"], step["sigma"], step["failures"], k, float(f), *map(float, m)) for k, (f, m) in enumerate(zip(centers, mu, strict=True))]
        write_intermediate(spark.createDataFrame(rows, "iteration int, sigma double, failures int, segment int, center_frame double, dx double, dy double, dz double"), rounds_to)

    try:
        mu, trace = anneal(
            blocks.objective, len(centers), sigma0, cfg.target_sigma_nm, cfg.max_drift_nm * cfg.drift_max_bound_factor, cfg.boxcar_width, cfg.criterion, cfg.refine,
            optimizer=cfg.optimizer, on_failure=cfg.on_failure, on_round=keep if rounds_to else None,
        )
    finally:
        blocks.release()
    return _result(spark, locs, cfg, seg, centers, mu, trace, params | {"n_pairs": blocks.n_pairs} | asdict(cfg))


def _result(spark, locs, cfg, seg, centers, mu, trace, params) -> DriftResult:
    frames = D.frame_axis(spark, cfg.min_max_frames[1]) if cfg.min_max_frames else D.frame_axis_of(locs)
    per_frame = interpolate(frames, centers, mu, cfg.interpolation_method)
    rows = [(k, float(f), *map(float, m)) for k, (f, m) in enumerate(zip(centers, mu, strict=True))]
    segments = spark.createDataFrame(rows, "segment int, center_frame double, dx double, dy double, dz double")
    names = ("iteration", "sigma", "delta", "cost", "evaluations", "good")
    steps = spark.createDataFrame([tuple(t[c] for c in names) for t in trace], "iteration int, sigma double, delta double, cost double, evaluations int, good boolean")
    return DriftResult(seg, segments, per_frame, D.apply(locs, per_frame), steps, params)


def refine_in_time(locs: DataFrame, cfg: DriftConfig = DriftConfig()) -> DriftResult:
    """From few long segments to many short ones at each width, each level starting from the spline of the one before.

    A level's pairs are those of the finest segments, relabelled. A width's levels end early where the trajectory (less
    its mean) begins to change more than at the level before.
    """
    seg, centers, blocks, params = _prepared(locs, cfg, None)
    total, bound = len(centers), cfg.max_drift_nm * cfg.drift_max_bound_factor
    axis = np.arange(np.floor(centers.min()), np.ceil(centers.max()) + 1)
    try:
        mu, at, trace = _refined(blocks, centers, total, bound, axis, cfg)
    finally:
        blocks.release()
    return _result(locs.sparkSession, locs, cfg, seg, at, mu, trace, params | {"n_pairs": blocks.n_pairs} | asdict(cfg))


def _refined(blocks: PairBlocks, centers: np.ndarray, total: int, bound: float, axis: np.ndarray, cfg: DriftConfig):
    from .minimisers import lbfgsb
    from .optimize import reflect_boxcar

    mu, at, path, deltas, trace = None, None, None, [], []
    sigma = cfg.max_drift_nm / 3.0
    while sigma >= max(1.0, cfg.target_sigma_nm):
        for level, n in enumerate(ladder(total) or [total]):
            relabel = np.minimum(np.arange(total) // (total // n), n - 1)
            mids = np.array([centers[relabel == k].mean() for k in range(n)])
            first = np.zeros((n, 3)) if mu is None else evaluate(*pieces(at, mu), mids)
            x, value, good, calls = lbfgsb(blocks.objective(sigma, relabel, n), reflect_boxcar(first, 3).ravel(), bound, ftol=1e-12)
            x = x.reshape(n, 3)
            now = evaluate(*pieces(mids, x), axis)
            now -= now.mean(0)
            delta = float(np.sqrt(((now - path) ** 2).sum(1)).mean()) if path is not None else float("nan")
            trace.append({"iteration": len(trace), "sigma": sigma, "delta": delta, "cost": float(value), "evaluations": calls, "good": bool(good)})
            if path is not None:
                deltas.append(delta)
                if level >= 2 and len(deltas) > 1 and delta > deltas[-2]:
                    break
            mu, at, path = x, mids, now
        sigma /= 1.5
    return mu, at, trace
