"""Pair search over a k-d partition of space, with a halo: no pair is lost where a split runs between its rows.

1. A bounded sample of the rows (``SAMPLES`` a leaf) is split at medians of the widest axis until there is a leaf for
   every ``LEAF_ROWS`` rows of the table, ``LEAVES`` at most. The tree travels to the tasks (some bytes a leaf).
2. Every row is at home in one leaf and visits the leaves within the radius of it. A leaf that still has more rows than
   ``LEAF_ROWS`` (a place that no split can part, or more rows than LEAVES leaves take) is searched in slots: each slot
   owns a share of the leaf's rows, dealt by their numbers, and all rows of leaf and halo pass by each.
3. A slot holds what it owns, sorted by cells of the radius, and finds partners of the rows that pass by with array
   searches: memory goes by LEAF_ROWS and one batch, however dense a place is. A pair is found from both of its rows and
   kept where the one with the smaller number is owned.

Compared with the join on cells (``pairs.within_radius``): rows travel once, and again for each leaf around, rather than
3.5 times on average, and there is no sort-merge join over them, but the search is Python over Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AXES
from .pairs import _ROW, MARGIN, numbered, turned

LEAF_ROWS, LEAVES, SAMPLES = 1 << 17, 1 << 15, 32
#: Candidates that are compared at a time.
AT_ONCE = 1 << 18


@dataclass
class Tree:
    """Inner nodes have an axis, a place and two children; a leaf has axis -1, and its number in ``left``."""

    axis: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n_leaves: int

    @classmethod
    def over(cls, points: np.ndarray, leaves: int) -> Tree:
        """Splits the points (n x 3) at medians until there are so many leaves, or nothing is left to part."""
        axis, place, left, right = [], [], [], []
        todo = [(points, leaves, None)]
        n = 0
        while todo:
            some, want, parent = todo.pop()
            if parent is not None:
                (left if parent[1] == 0 else right)[parent[0]] = len(axis)
            wide = np.ptp(some, axis=0) if len(some) else np.zeros(3)
            a = int(wide.argmax())
            if want > 1 and wide[a] > 0:
                low = want // 2
                s = np.sort(some[:, a])
                cut_at = s[min(len(s) - 1, max(1, len(s) * low // want))]
                if cut_at == s[0]:  # equal values at the low end stay together on the left
                    cut_at = s[np.searchsorted(s, s[0], "right")]
                todo += [(some[some[:, a] < cut_at], low, (len(axis), 0)), (some[some[:, a] >= cut_at], want - low, (len(axis), 1))]
                axis.append(a), place.append(cut_at), left.append(-1), right.append(-1)
            else:
                axis.append(-1), place.append(0.0), left.append(n), right.append(-1)
                n += 1
        return cls(np.array(axis), np.array(place), np.array(left), np.array(right), n)

    def visits(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether at home) of all visits; one step of array operations for each level."""
        row, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        done = []
        while row.size:
            inner = self.axis[node] >= 0
            done.append((row[~inner], self.left[node[~inner]], home[~inner]))
            row, node, home = row[inner], node[inner], home[inner]
            at, s = points[row, self.axis[node]], self.place[node]
            down = at < s
            go = [(at - reach < s, self.left, down), (at + reach >= s, self.right, ~down)]
            row, node, home = (np.concatenate(v) for v in ([row[g] for g, _, _ in go], [to[node[g]] for g, to, _ in go], [(home & side)[g] for g, _, side in go]))
        return tuple(np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))


def tree_of(rows: DataFrame, n_rows: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """From a sample of rows (numbered) of SAMPLES a leaf on average."""
    leaves = min(LEAVES, max(1, math.ceil(n_rows / leaf_rows)))
    if leaves == 1:
        return Tree.over(np.zeros((0, 3)), 1)
    share = max(1, n_rows // (leaves * SAMPLES))
    some = rows.filter(F.pmod(F.xxhash64(_ROW), F.lit(share)) == 0).select(*AXES).limit(4 * leaves * SAMPLES).toArrow()
    points = np.stack([some.column(a).to_numpy() for a in AXES], 1) if some.num_rows else np.zeros((0, 3))
    return Tree.over(points, leaves)


def _place(tree: Tree, reach: float, kept: list[str], slots: np.ndarray | None = None):
    """Rows with their leaf and slot, and whether the slot owns them; without ``slots``, homes alone."""

    def run(batches):
        for b in batches:
            points = np.stack([b.column(a).to_numpy(zero_copy_only=False) for a in AXES], 1)
            row, leaf, home = tree.visits(points, reach)
            if slots is None:
                yield pa.RecordBatch.from_arrays([pa.array(leaf[home])], names=["leaf"])
                continue
            n = slots[leaf]
            row, leaf, home, n = (np.repeat(v, n) for v in (row, leaf, home, n))
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])))[: row.size]
            slot = np.arange(row.size) - np.repeat(first, np.diff(np.append(first, row.size)))
            number = b.column(_ROW).to_numpy()[row]
            own = home & (((number ^ (number >> 33)) % n) == slot)
            for lo in range(0, row.size, 1 << 16):
                k = slice(lo, lo + (1 << 16))
                part = b.take(pa.array(row[k]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[k]), pa.array(slot[k]), pa.array(own[k]), *(part.column(c) for c in kept)], names=["leaf", "slot", "own", *kept])

    return run


class _Owned:
    """What a slot owns, sorted by cells of the reach; cells are numbered by the coordinates that occur, so that keys fit."""

    def __init__(self, rows: pa.Table, reach: float):
        points = np.stack([rows.column(a).to_numpy() for a in AXES], 1)
        cells = np.floor(points / reach)
        self.seen = [np.unique(cells[:, k]) for k in range(3)]
        ranks = [np.searchsorted(self.seen[k], cells[:, k]) for k in range(3)]
        keys = self._key(*ranks)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows, self.points, self.reach = keys[order], rows.take(pa.array(order)), points[order], reach
        self.number = self.rows.column(_ROW).to_numpy()

    def _key(self, x, y, z):
        return (x * self.seen[1].size + y) * (self.seen[2].size + 1) + z

    def partners(self, points: np.ndarray, number: np.ndarray, square: float):
        """(owned row, row that passes by) of all close pairs whose owned row has the smaller number, some at a time."""
        cells = np.floor(points / self.reach)
        low, high = np.searchsorted(self.seen[2], cells[:, 2] - 1, "left"), np.searchsorted(self.seen[2], cells[:, 2] + 1, "right")
        for dx in (-1, 0, 1):
            x = np.searchsorted(self.seen[0], cells[:, 0] + dx)
            has_x = (x < self.seen[0].size) & (self.seen[0][np.minimum(x, self.seen[0].size - 1)] == cells[:, 0] + dx)
            for dy in (-1, 0, 1):
                y = np.searchsorted(self.seen[1], cells[:, 1] + dy)
                at = np.flatnonzero(has_x & (y < self.seen[1].size) & (self.seen[1][np.minimum(y, self.seen[1].size - 1)] == cells[:, 1] + dy))
                a, b = (np.searchsorted(self.keys, self._key(x[at], y[at], z[at])) for z in (low, high))
                some = b > a
                at, a, b = at[some], a[some], b[some]
                yield from self._compared(points, number, square, at, a, b)

    def _compared(self, points, number, square, at, a, b):
        """The runs a .. b of owned rows beside the rows ``at``, AT_ONCE candidates at a time (a long run in pieces)."""
        many = b - a
        pieces = -(-many // AT_ONCE)
        first = np.repeat(a, pieces) + AT_ONCE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        at, last = np.repeat(at, pieces), np.minimum(first + AT_ONCE, np.repeat(b, pieces))
        upto = np.cumsum(last - first)
        lo = 0
        while lo < at.size:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
            n = last[lo:hi] - first[lo:hi]
            mine = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            theirs = np.repeat(at[lo:hi], n)
            keep = self.number[mine] < number[theirs]
            mine, theirs = mine[keep], theirs[keep]
            d = self.points[mine] - points[theirs]
            near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= square
            yield mine[near], theirs[near]
            lo = hi


def _search(radius: float, reach: float, sided: list[str]):
    """Rows by leaf and slot, owned ones first in each: the pairs, as columns of both rows and their difference."""

    def run(batches):
        at, held, owned = None, [], None

        def pairs(b):
            points = np.stack([b.column(a).to_numpy() for a in AXES], 1)
            for mine, theirs in owned.partners(points, b.column(_ROW).to_numpy(), radius * radius):
                if mine.size:
                    left, right = owned.rows.take(pa.array(mine)), b.take(pa.array(theirs))
                    d = owned.points[mine] - points[theirs]
                    arrays = [*(left.column(c).combine_chunks() for c in sided), *(right.column(c) for c in sided), *(pa.array(d[:, k]) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*(f"{c}_a" for c in sided), *(f"{c}_b" for c in sided), *(f"d{a}0" for a in AXES)])

        for batch in batches:
            leaf, slot, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "slot", "own"))
            new = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (slot[1:] != slot[:-1]) | (own[1:] != own[:-1])))
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                here, part = (int(leaf[lo]), int(slot[lo])), batch.slice(lo, hi - lo)
                if here != at:
                    if at is not None and held:  # a slot that owns all that passes by
                        owned = _Owned(pa.Table.from_batches(held), reach)
                        for b in held:
                            yield from pairs(b)
                    at, held, owned = here, [], None
                if own[lo]:
                    held.append(part)
                    continue
                if held:
                    owned = _Owned(pa.Table.from_batches(held), reach)
                    for b in held:
                        yield from pairs(b)
                    held = []
                if owned is not None:
                    yield from pairs(part)
        if held:
            owned = _Owned(pa.Table.from_batches(held), reach)
            for b in held:
                yield from pairs(b)

    return run


def within_radius_kd(locs: DataFrame, radius: float, carry: tuple[str, ...] = (), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """All unordered pairs of rows at a distance of ``radius`` or less, with the columns of ``pairs.within_radius``.

    Rows without a place (a null or NaN coordinate) have no partners.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    spark, reach = locs.sparkSession, radius * (1 + MARGIN)
    kept = ["loc_id", _ROW, *AXES, *carry]
    finite = " AND ".join(f"{a} BETWEEN -1.7976931348623157E308D AND 1.7976931348623157E308D" for a in AXES)
    rows = (locs if _ROW in locs.columns else numbered(locs)).select(*kept).filter(finite)
    n_rows = rows.count()
    tree = tree_of(rows, n_rows, leaf_rows)
    held = spark.sparkContext.broadcast(tree)  # LEAVES at most
    homes = rows.select(*AXES).mapInArrow(lambda b: _place(held.value, 0.0, [])(b), "leaf long").groupBy("leaf").count().toArrow()
    slots = np.ones(tree.n_leaves, np.int64)
    slots[homes.column("leaf").to_numpy()] = -(-homes.column("count").to_numpy() // leaf_rows)  # a number a leaf
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    dealt = rows.mapInArrow(lambda b: _place(held.value, reach, kept, slots)(b), f"leaf long, slot long, own boolean, {ddl}")
    dealt = dealt.repartition(max(1, 3 * int(slots.sum())), "leaf", "slot").sortWithinPartitions("leaf", "slot", F.desc("own"))
    sided = ["loc_id", *carry]
    out = ", ".join([*(f"`{c}_{s}` {rows.schema[c].dataType.simpleString()}" for s in "ab" for c in sided), *(f"d{a}0 double" for a in AXES)])
    return turned(dealt.mapInArrow(_search(radius, reach, sided), out), carry)
