"""Pair search. A radius search is an equi-join on grid cells of two radii: each row is at home in one cell and visits the
cells after it (in order) that its search box touches, three and a half on average, so that every close pair meets once,
and a residual distance test decides. Hot cells are split by adaptive execution.

Where pairs are only summed up, ``chunks_within`` lets chunks of a cell's rows meet in the same join, and ``pairs_met``
makes the pairs in the task that takes them, so that no pair is a row of a table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from ..sources.scratch import cut
from .ordered import numbered as ordered_numbers

#: The box is searched a little wider than the radius, and cells are wider than two of it: rounding loses no pair.
MARGIN = 1e-6
#: Visits are rows that the planner's size estimates do not see: both sides are shuffled by cell, never broadcast.
JOIN = "merge"
_ROW = "__row"
#: Ids in a row of a histogram's index.
PIECE = 4096
#: Rows in a chunk at most, and pairs of rows that are tested at a time.
CHUNK, TESTED = 64, 1 << 18


def numbered(locs: DataFrame) -> DataFrame:
    """The rows with a number each, written once, so that both sides of a self-join see the same numbers."""
    return cut(locs.withColumn(_ROW, F.monotonically_increasing_id()))


def within_radius(locs: DataFrame, radius: float, carry: tuple[str, ...] = (), flat: bool = False, unique: bool = False) -> DataFrame:
    """All unordered pairs of rows at a distance of ``radius`` or less: loc_i <= loc_j, dx0, dy0, dz0 (i less j), and
    ``carry`` columns of both with suffixes _i and _j. With ``flat``, z is taken to be 0 everywhere, and fewer cells are
    visited.

    Rows are paired, not ids: rows that share an id (null ones too) pair with each other, and which of them is i is left
    open. ``unique``: the caller knows that no id repeats or is null, which saves numbering the rows.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    if not unique:
        locs = locs if _ROW in locs.columns else numbered(locs)
    axes = AXES[:2] if flat else AXES
    reach, size = radius * (1 + MARGIN), 2 * radius * (1 + 2 * MARGIN)
    own = {a: F.floor(F.col(a) / size) for a in axes}
    order = ("loc_id",) if unique else ("loc_id", _ROW)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in (*order, *AXES, *carry)]
    left = locs.select(*side("a"), *(own[a].alias(f"c{a}") for a in axes))
    right = locs.select(*side("b"), *(own[a].alias(f"h{a}") for a in axes))
    for a in axes:
        here = F.col(f"{a}_b")
        right = right.select("*", F.explode(F.sequence(F.floor((here - reach) / size), F.floor((here + reach) / size))).alias(f"c{a}"))
    cell, home = F.struct(*(F.col(f"c{a}").alias(a) for a in axes)), F.struct(*(F.col(f"h{a}").alias(a) for a in axes))
    right = right.filter(cell >= home).withColumn("own", cell == home).drop(*(f"h{a}" for a in axes))
    d = {a: F.col(f"{a}_a") - F.col(f"{a}_b") for a in AXES}
    near = reduce(lambda p, q: p + q, (d[a] * d[a] for a in AXES)) <= radius * radius
    number = "loc_id" if unique else _ROW
    met = left.join(right.hint(JOIN), [f"c{a}" for a in axes]).filter(near & (~F.col("own") | (F.col(f"{number}_a") < F.col(f"{number}_b"))))
    return turned(met.select("*", *(d[a].alias(f"d{a}0") for a in AXES)), carry, unique)


def turned(met: DataFrame, carry: tuple[str, ...], unique: bool = False) -> DataFrame:
    """Pairs of rows a and b with their difference, so that the one with the smaller id (null ids come last) is i."""
    first = F.col("loc_id_a") <= F.col("loc_id_b")
    if not unique:
        first = F.coalesce(first, F.col("loc_id_a").isNotNull())
    turn = lambda c: (F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    i, j = turn("loc_id")
    out = [i.alias("loc_i"), j.alias("loc_j"), *(F.when(first, F.col(f"d{a}0")).otherwise(-F.col(f"d{a}0")).alias(f"d{a}0") for a in AXES)]
    for c in carry:
        ci, cj = turn(c)
        out += [ci.alias(f"{c}_i"), cj.alias(f"{c}_j")]
    return met.select(*out)


def _chunked(batches):
    """Rows in order of their cells as chunks: the cell, a number, the bounds, and x, y, z and segment of each row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        of = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        cell = np.stack([of[f"c{a}"] for a in AXES])
        begin = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0)))
        first = np.flatnonzero((np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))) % CHUNK == 0)
        rows = np.stack([of[c].astype("<f8") for c in (*AXES, "segment")], 1)
        ends = (np.append(first, n) * rows.strides[0]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), first.size, [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        bounds = {f"{a}_{m}": f.reduceat(of[a], first) for a in AXES for m, f in (("lo", np.minimum), ("hi", np.maximum))}
        yield pa.RecordBatch.from_pydict({**{f"c{a}": of[f"c{a}"][first] for a in AXES}, "id": of[_ROW][first], **bounds, "rows": packed})


def chunks_within(locs: DataFrame, radius: float) -> DataFrame:
    """Which chunks of numbered rows (of one cell each) to hold against which, for ``pairs_met``: same, rows_a, rows_b.

    As in ``within_radius``, a chunk is at home in one cell and visits those after it that its bounds, widened by the
    radius, touch. Cells of any size are as many chunks as it takes, on as many tasks as adaptive execution makes.
    """
    reach, size = radius * (1 + MARGIN), 2 * radius * (1 + 2 * MARGIN)
    cell_of = [f"c{a}" for a in AXES]
    rows = locs.filter(reduce(lambda p, q: p & q, (F.abs(F.col(a)) < float("inf") for a in AXES)))  # neither null nor NaN
    rows = rows.select(*(F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES), _ROW, *AXES, "segment")
    rows = rows.hint("rebalance", *map(F.col, cell_of)).sortWithinPartitions(*cell_of, "x")
    bounds = [f"{a}_{m}" for a in AXES for m in ("lo", "hi")]
    # written, so that both sides see the same chunks
    chunks = cut(rows.mapInArrow(_chunked, ", ".join([*(f"{c} long" for c in (*cell_of, "id")), *(f"{b} double" for b in bounds), "rows binary"])))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", *bounds, "rows")]
    left, right = chunks.select(*side("a"), *cell_of), chunks.select(*side("b"), *(F.col(f"c{a}").alias(f"h{a}") for a in AXES))
    for a in AXES:
        right = right.select("*", F.explode(F.sequence(F.floor((F.col(f"{a}_lo_b") - reach) / size), F.floor((F.col(f"{a}_hi_b") + reach) / size))).alias(f"c{a}"))
    cell, home = F.struct(*(F.col(f"c{a}").alias(a) for a in AXES)), F.struct(*(F.col(f"h{a}").alias(a) for a in AXES))
    right = right.filter(cell >= home).withColumn("own", cell == home).drop(*(f"h{a}" for a in AXES))
    near = reduce(lambda p, q: p & q, ((F.col(f"{a}_lo_{s}") - F.col(f"{a}_hi_{t}") <= reach) for a in AXES for s, t in ("ab", "ba")))
    met = left.join(right.hint(JOIN), cell_of).filter(near & (~F.col("own") | (F.col("id_a") <= F.col("id_b"))))
    return met.select((F.col("id_a") == F.col("id_b")).alias("same"), "rows_a", "rows_b")


def pairs_met(batch: pa.RecordBatch, radius: float):
    """The pairs within the radius among rows of ``chunks_within``, some at a time: segments i and j, differences by axis."""

    def side(name):
        column = batch.column(name)
        rows = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, 4)
        many = pc.binary_length(column).to_numpy() // rows.strides[0]
        return rows, many, np.append(0, np.cumsum(many))

    def close(rows, of, others, first):
        """Rows within the widened bounds of the other chunk."""
        lo, hi = np.minimum.reduceat(others[:, :3], first) - reach, np.maximum.reduceat(others[:, :3], first) + reach
        return ((rows[:, :3] >= lo[of]) & (rows[:, :3] <= hi[of])).all(1)

    same, reach = batch.column("same").to_numpy(zero_copy_only=False), radius * (1 + MARGIN)
    (a, na, at_a), (b, nb, at_b) = side("rows_a"), side("rows_b")
    tested = np.cumsum(na * nb)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(tested, (tested[lo - 1] if lo else 0) + TESTED, "right")))
        of_a, of_b = (np.repeat(np.arange(hi - lo), n[lo:hi]) for n in (na, nb))
        rows_a, rows_b = a[at_a[lo] : at_a[hi]], b[at_b[lo] : at_b[hi]]
        in_a, in_b = close(rows_a, of_a, rows_b, at_b[lo:hi] - at_b[lo]), close(rows_b, of_b, rows_a, at_a[lo:hi] - at_a[lo])
        rows_a, of_a, rows_b, of_b = rows_a[in_a].T.copy(), of_a[in_a], rows_b[in_b].T.copy(), of_b[in_b]
        many_a, many_b = (np.bincount(of, minlength=hi - lo) for of in (of_a, of_b))
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        times = many_b[of_a]  # each row of a meets the rows of the chunk opposite
        ib = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first_b[of_a], times)
        d = np.stack([np.repeat(rows_a[k], times) - rows_b[k][ib] for k in range(3)])
        near = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius
        if same[lo:hi].any():  # a chunk against itself: each pair once
            after = np.where(same[lo:hi][of_a], np.arange(of_a.size) - first_a[of_a], -1)
            near &= np.repeat(after, times) < (np.arange(of_b.size) - first_b[of_b])[ib]
        yield np.repeat(rows_a[3], times)[near].astype(np.int64), rows_b[3][ib[near]].astype(np.int64), d[:, near]
        lo = hi


def _shifted(locs: DataFrame) -> DataFrame:
    """The rows beside the least coordinate of each axis (one row is joined to all)."""
    return locs.crossJoin(F.broadcast(locs.agg(*(F.min(a).alias(f"{a}_min") for a in AXES), *(F.max(a).alias(f"{a}_max") for a in AXES))))  # one row


def min_shifted(locs: DataFrame) -> DataFrame:
    return _shifted(locs).select("loc_id", *((F.col(a) - F.col(f"{a}_min")).alias(a) for a in AXES), "frame")


def cells(locs: DataFrame, size: float, bounded: bool = False) -> DataFrame:
    """The rows with cells cx, cy, cz counted from the least coordinate. ``bounded``: the last of ceil(range / size) cells
    (one at least) takes its upper edge as well.
    """
    out = _shifted(locs)
    for a in AXES:
        c = F.floor((F.col(a) - F.col(f"{a}_min")) / size)
        if bounded:
            c = F.least(c, F.greatest(F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / size), F.lit(1)) - 1)
        out = out.withColumn(f"c{a}", c.cast("long"))
    return out.drop(*(f"{a}_{m}" for a in AXES for m in ("min", "max")))


def estimate(locs: DataFrame, max_drift: float) -> DataFrame:
    """One row: sum of n (n - 1) over the cells, and the same rounded to ten thousands (half to even)."""
    counts = cells(locs, max_drift).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).cast("long")
    return counts.agg(total.alias("n_pairs")).select("n_pairs", F.bround(F.col("n_pairs").cast("decimal(38,0)"), -4).cast("long").alias("n_pairs_rounded"))


#: Rows whose partners are counted, and standard errors to either side of an expected number.
SAMPLED, ERRORS = 4000, 3.0
_AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def expected(locs: DataFrame, radius: float, sampled: int = SAMPLED) -> DataFrame:
    """One row: how many pairs ``within_radius`` would find, without finding them.

    n_candidates is exact, and no fewer than the pairs: cells of the radius are counted, and each count is multiplied
    with those of the cells around it. Of about ``sampled`` rows, chosen by a hash, the candidates and the partners
    within the radius are counted; their ratio times n_candidates is n_pairs, with n_least and n_most to either side
    (ERRORS standard errors of a ratio; a table of ``sampled`` rows or fewer is counted as a whole). Rows are read three
    times, and what is shuffled are counts of cells; the sampled rows' visits, 27 a row, are broadcast.
    """
    rows = (locs if _ROW in locs.columns else numbered(locs)).select(_ROW, *AXES).dropna()
    size = radius * (1 + 2 * MARGIN)
    rows = rows.withColumns({f"c{a}": F.floor(F.col(a) / size).cast("long") for a in AXES})
    cells_, around = cut(rows.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))), [f"c{a}" for a in AXES]
    half = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xyz", o, strict=True))) for o in _AROUND if o > (0, 0, 0)))
    beside = cells_.withColumn("o", F.explode(half)).select(*((F.col(f"c{a}") + F.col(f"o.{a}")).alias(f"c{a}") for a in AXES), F.col("n").alias("m"))
    total = cells_.agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("own"), F.sum("n").alias("n")).crossJoin(cells_.join(beside.hint(JOIN), around).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("others")))  # one row each
    n_rows, candidates = total.select(F.coalesce("n", F.lit(0)), F.coalesce((F.col("own") + F.col("others")).cast("long"), F.lit(0))).first()
    share = max(1, n_rows // sampled)
    some = rows.filter(F.pmod(F.xxhash64(_ROW), F.lit(share)) == 0).limit(2 * sampled)
    whole = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xyz", o, strict=True))) for o in _AROUND))
    visits = some.withColumn("o", F.explode(whole)).select(F.col(_ROW).alias("me"), *(F.col(a).alias(f"{a}_me") for a in AXES), *((F.col(f"c{a}") + F.col(f"o.{a}")).alias(f"c{a}") for a in AXES))
    square = reduce(lambda p, q: p + q, ((F.col(a) - F.col(f"{a}_me")) * (F.col(a) - F.col(f"{a}_me")) for a in AXES))
    met = rows.join(F.broadcast(visits), around).filter(F.col(_ROW) != F.col("me"))  # 54 times ``sampled`` rows at most
    per = met.groupBy("me").agg(F.count("*").alias("x"), F.count_if(square <= radius * radius).alias("y"))
    sums = per.agg(*(F.coalesce(F.sum(F.col(p).cast("double") * F.col(q)), F.lit(0.0)).alias(p + q) for p, q in ("xx", "xy", "yy")), *(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"s{c}") for c in "xy"), F.count("*").alias("k"))
    ratio = F.when(F.col("sx") > 0, F.col("sy") / F.col("sx")).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.col("yy") - 2 * F.col("r") * F.col("xy") + F.col("r") * F.col("r") * F.col("xx"), F.lit(0.0)) * F.col("k") / F.greatest(F.col("k") - 1, F.lit(1)))
    off = F.when((F.col("sx") == 0) | F.lit(share == 1), 0.0).otherwise(ERRORS * spread / F.col("sx"))
    out = sums.withColumn("r", ratio).withColumn("off", off)
    near = lambda c: F.round(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * candidates).cast("long")
    return out.select(F.lit(candidates).cast("long").alias("n_candidates"), near(F.col("r")).alias("n_pairs"), near(F.col("r") - F.col("off")).alias("n_least"), near(F.col("r") + F.col("off")).alias("n_most"))


def _once(locs: DataFrame) -> DataFrame:
    """loc_id and a number for each row."""
    return (locs if _ROW in locs.columns else numbered(locs)).select("loc_id", _ROW)


def _in_order(met: DataFrame) -> DataFrame:
    """loc_i and loc_j of pairs of rows (loc_id_a, loc_id_b): the smaller id first, null ids last."""
    first = F.coalesce(F.col("loc_id_a") <= F.col("loc_id_b"), F.col("loc_id_a").isNotNull())
    return met.select(F.when(first, F.col("loc_id_a")).otherwise(F.col("loc_id_b")).alias("loc_i"), F.when(first, F.col("loc_id_b")).otherwise(F.col("loc_id_a")).alias("loc_j"))


def within_cells(locs: DataFrame, size: float) -> DataFrame:
    """All pairs of rows of one cell, without a distance test and without neighbours: loc_i <= loc_j (as in
    ``within_radius``, rows are paired and not ids). Both sides are shuffled by cell, so that a hot cell is split.
    """
    c = cells(locs if _ROW in locs.columns else numbered(locs), size, bounded=True).select("cx", "cy", "cz", "loc_id", _ROW)
    side = lambda s: c.select("cx", "cy", "cz", F.col("loc_id").alias(f"loc_id_{s}"), F.col(_ROW).alias(f"{_ROW}_{s}"))
    return _in_order(side("a").join(side("b").hint(JOIN), ["cx", "cy", "cz"]).filter(f"{_ROW}_a < {_ROW}_b"))


def histogram(locs: DataFrame, size: float, piece: int = PIECE) -> DataFrame:
    """Cells and which rows are in them, as a compressed index: the rows' ids in order of cells and ids are one list, cut
    at multiples of ``piece`` and at the ends of cells. Each row of the result is one cut: cx, cy, cz, the place in the
    list at which it begins, its length n, and its loc_ids. A cell of any size is as many rows as it takes.
    """
    order = ["cx", "cy", "cz", "loc_id"]
    listed = ordered_numbers(cells(locs, size, bounded=True).select(*order), order, "k")
    cut_at = listed.groupBy("cx", "cy", "cz", F.expr(f"k DIV {piece}").alias("__piece"))
    return cut_at.agg(F.min("k").alias("first"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "loc_id"))), lambda r: r["loc_id"]).alias("loc_ids")).drop("__piece")


def every_pair(locs: DataFrame) -> DataFrame:
    """All pairs of rows: for a handful of rows only, as their number is n (n - 1) / 2."""
    few = _once(locs)
    side = lambda s: few.select(F.col("loc_id").alias(f"loc_id_{s}"), F.col(_ROW).alias(f"{_ROW}_{s}"))
    return _in_order(side("a").join(side("b"), F.col(f"{_ROW}_a") < F.col(f"{_ROW}_b")))


def squared(d: list[Column]) -> Column:
    return sum((c * c for c in d[1:]), d[0] * d[0])
