"""Removal of repeated substrings with suffix arrays.

Every byte of a text that is covered by a 50-byte string which also starts in a document with a smaller id is removed.
The steps keep volumes in proportion to the input:

1. Exact copies: digests are grouped (partial aggregation); all but the smallest id of a group go as a whole, and only
   the first goes on.
2. Routing. Of the 31 grams of 20 bytes of every 50-byte window, the one with the least hash (the rightmost if
   several) is its anchor; equal windows have equal anchors. One (anchor, document) row for each of a document's
   distinct anchors, some 1 in 16 bytes, is dealt by anchor; anchors of a single document are dropped there.
3. Fragments. For each anchor that documents share, the bytes of the windows that it anchors (50 to 80) are dealt by
   anchor to shards.
4. A shard's fragments are laid end to end. Its suffix array is refined as by Larsson and Sadakane: ranks by eight
   bytes, then doubled depths, only groups that are still tied being sorted again. Kasai's pass, side by side for all
   fragments, gives the common prefixes of neighbours; neighbours with 50 bytes in common are one string, whose smallest
   id decides. An anchor with more fragments than a shard holds is cut into several: their sorted windows are merged
   by binary search.
5. The removed spans go back to their documents.

Hot anchors (a passage in a third of all documents): within ``GROUP_BYTES`` of text, documents after the first few
with one anchor do not enter step 2 at all, for their anchor is known to be shared; a fragment equal to one of a
smaller id in the same group is known to be removed and is not dealt. A hot anchor's windows are dealt by their own
hashes instead of the anchor, so that those at the passage's edges, which differ from document to document, spread.

Memory: the shuffles have as many partitions as the bytes of the texts ask for (``PART_BYTES``). A task of step 2 passes
the rows of a hot anchor on as soon as it is known to be hot; a task of step 4 folds equal fragments of one key to that
of the smallest id whenever it holds a shard of them, so that a window common to the corpus is held once.

Nulls: a null text is empty; a null id ranks after all others (an id of 2**63 - 1 ranks the same), and null ids do not
precede each other. Rows that repeat an id never remove each other's bytes. Texts under 50 bytes stay. Ties: windows of
one id are judged by smaller ids alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, eights, mix, parts, release, small_batches, span_hash, steps, table, text_bytes

WIDTH, GRAM = 50, 20
SPREAD = WIDTH - GRAM + 1
GROUP_BYTES, DEALT_BYTES = 8 * STEP_BYTES, 32 * STEP_BYTES
#: An anchor that so many documents of one group have is hot, as is one with so many rows in all.
HOT_IN_GROUP, HOT_ROWS = 32, 20_000
SHARD_BYTES = 1 << 20
#: Bytes of text for each partition of a shuffle, and rows that a task of step 2 holds before it looks for hot anchors.
PART_BYTES, HELD_ROWS = 64 << 20, 4_000_000
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Bounds:
    """What the steps hold at a time; the results do not depend on it."""

    group_bytes: int = field(default_factory=lambda: GROUP_BYTES)
    dealt_bytes: int = field(default_factory=lambda: DEALT_BYTES)
    hot_in_group: int = field(default_factory=lambda: HOT_IN_GROUP)
    hot_rows: int = field(default_factory=lambda: HOT_ROWS)
    shard_bytes: int = field(default_factory=lambda: SHARD_BYTES)
    part_bytes: int = field(default_factory=lambda: PART_BYTES)
    held_rows: int = field(default_factory=lambda: HELD_ROWS)


_PLACE = np.uint64((1 << 26) - 1)
#: Anchors travel with 48 bits (chance agreement only costs a look), which leaves the low bits for marks.
_ANCHOR = ~np.uint64(0xFFFF)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first and last window start (in ``data``), and the anchor's hash."""
    n = data.size - WIDTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    x = eights(data)
    g = np.zeros(data.size - GRAM + 1, np.uint64)
    for k in sorted({*range(0, GRAM - 7, 8), GRAM - 8}):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + x[k : k + g.size])
    place = np.arange(g.size, dtype=np.uint64) & _PLACE
    v = (g & ~_PLACE) | (_PLACE - place)
    size = 1
    while 2 * size <= SPREAD:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    v = np.minimum(v[:n], v[SPREAD - size : SPREAD - size + n])
    ok = np.ones(data.size + 1, bool)
    size = np.diff(at)
    for end, s in zip(at[1:].tolist(), size.tolist(), strict=True):
        ok[max(end - WIDTH + 1, end - s) : end] = False
    starts = np.flatnonzero(ok[:n])
    if not starts.size:
        return none, none, none, np.zeros(0, np.uint64)
    low = _PLACE - (v[starts] & _PLACE)
    pos = starts + ((low - starts.astype(np.uint64)) & _PLACE).astype(np.int64)
    row = np.searchsorted(at, starts, "right") - 1
    turn = np.ones(starts.size, bool)
    turn[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(turn)
    last = np.append(first[1:], starts.size) - 1
    return row[first], starts[first], starts[last], g[pos[first]] & _ANCHOR


def _pack(batches):
    """Texts compressed one by one: they are shuffled once and read three times."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int32())], names=["id", "u", "z", "n"])


def _unpack(batches):
    """The batches with ``text`` (bytes) in place of its compressed form."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = [codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(batch.column("z").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        others = [c for c in batch.schema.names if c not in ("z", "n")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.binary())], names=[*others, "text"])


def _groups(batches: Iterator[pa.RecordBatch], most: int):
    """Slices of at most so many bytes of text."""
    for batch in _unpack(batches):
        for part, data, at in steps(batch, "text", most):
            yield part, data, at
        release()


def _pieces(part: pa.RecordBatch):
    """Of one group, the smaller steps that array operations run on, with each step's first row."""
    done = 0
    for some, data, at in steps(part, "text"):
        yield done, some, data, at
        done += some.num_rows


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _route(batches, bounds: Bounds | None = None):
    """(k, x, d, u): dealt by k, the anchor, with x null; x equal to k marks a hot anchor's first row of a group; rows
    with another x are the further documents of a hot anchor x, dealt anywhere. u tells documents without an id apart.
    """
    bounds = bounds or Bounds()
    for part, _, _ in _groups(batches, bounds.group_bytes):
        ids, own = _ids(part), part.column("u").to_numpy()
        hs, ds, us = [], [], []
        for base, _, data, at in _pieces(part):
            row, _, _, h = anchors(data, at)
            hs.append(h)
            ds.append(ids[base + row])
            us.append(own[base + row])
        h, d, u = np.concatenate(hs), np.concatenate(ds), np.concatenate(us)
        some = bool(u.any())
        order = np.lexsort((u, d, h) if some else (d, h))
        h, d, u = h[order], d[order], u[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (u[1:] != u[:-1])
        h, d, u = h[new], d[new], u[new]
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        hot = np.repeat(n >= bounds.hot_in_group, n)
        lead = np.zeros(h.size, bool)
        lead[first] = True
        order = np.argsort(d, kind="stable")  # rows of one document together: they compress better
        h, d, u, hot, lead = h[order], d[order], u[order], hot[order], lead[order]
        k = np.where(hot & ~lead, mix(h ^ ((d + u).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1), h)
        for lo in range(0, h.size, 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[s].view(np.int64)), pa.array(h[s].view(np.int64), mask=~hot[s]), pa.array(d[s]), pa.array(u[s])], names=["k", "x", "d", "u"])


def _shared(batches, bounds: Bounds | None = None):
    """(d, u, h) of the anchors that several documents have; the low bit of h tells the hot ones.

    Rows of an anchor are held until it is known whether it is hot, and all others to the end of the partition; a hot
    anchor's rows are passed on at once but for those of one document, until a second document is seen.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    bounds = bounds or Bounds()
    held, size, most, sure_hot = [none], 0, bounds.held_rows, np.zeros(0, np.uint64)

    def out(d, u, h):
        for lo in range(0, d.size, 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(u[s]), pa.array(h[s].view(np.int64))], names=["d", "u", "h"])

    def sorted_rows():
        k, d, u, mark = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(k, kind="stable")
        k, d, u, mark = k[order], d[order], u[order], mark[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if k.size else np.zeros(0, np.int64)
        if not first.size:
            return (k, d, u, mark), first, first, np.zeros(0, bool), np.zeros(0, bool)
        n = np.diff(np.append(first, k.size))
        marked = np.logical_or.reduceat(mark, first)
        many = marked | (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))
        return (k, d, u, mark), first, n, many, marked | (n >= bounds.hot_rows)

    for batch in batches:
        k, d, u = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "d", "u"))
        k = k.view(np.uint64)
        has = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
        x = batch.column("x").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sure = has & (x != k)
        yield from out(d[sure], u[sure], x[sure] | np.uint64(1))
        known = ~sure & np.isin(k, sure_hot) if sure_hot.size else np.zeros(k.size, bool)
        yield from out(d[known], u[known], k[known] | np.uint64(1))
        rest = ~sure & ~known
        held.append((k[rest], d[rest], u[rest], has[rest]))
        size += int(rest.sum())
        if size >= most:
            (k, d, u, mark), first, n, many, hot = sorted_rows()
            go = np.repeat(many & hot, n)  # shared for certain, and hot: nothing that comes later changes that
            yield from out(d[go], u[go], k[go] | np.uint64(1))
            sure_hot = np.union1d(sure_hot, k[first[many & hot]])
            alone = np.repeat(~many & hot, n)  # many rows of one document: one of them stands for all
            alone[first] = False
            stay = ~go & ~alone
            held, size = [(k[stay], d[stay], u[stay], mark[stay])], int(stay.sum())
            most = max(bounds.held_rows, 2 * size)
    (k, d, u, _), _, n, many, hot = sorted_rows()
    keep = np.repeat(many, n)
    yield from out(d[keep], u[keep], k[keep] | np.repeat(hot, n)[keep].astype(np.uint64))
    release()


def _gather(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans, end to end, and their bounds."""
    size = hi - lo
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(bounds[-1]) + np.repeat(lo - bounds[:-1], size)], bounds


_FRAGMENT = pa.schema([("k", pa.int64()), ("frag", pa.binary()), ("d", pa.int64()), ("t", pa.int64()), ("pos", pa.binary()), ("n", pa.int32())])


def _text_key(data: np.ndarray, at: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    """A 64-bit key of each row's text, to tell apart texts that share an id or have none; 0 where the id has one text."""
    twin, u = (part.column(c).to_numpy(zero_copy_only=False) for c in ("twin", "u"))
    return np.where(u != 0, u, np.where(twin, span_hash(data, at[:-1], at[1:]).view(np.int64), 0))


def _fragments(batches, bounds: Bounds | None = None):
    """(k, frag, d, t, pos, n): n windows from byte pos on; without frag where they are known to be removed.

    Works through the partition in groups of ``dealt_bytes`` of text.
    """
    bounds = bounds or Bounds()
    found, size = [], 0
    for part, _, _ in _groups(batches, bounds.group_bytes):
        ids, asked = _ids(part), part.column("hs").to_pylist()
        for base, some, data, at in _pieces(part):
            found.append(_cut_out(data, at, ids[base : base + some.num_rows], asked[base : base + some.num_rows], some))
            size += data.size
        if size >= bounds.dealt_bytes:
            yield from _deal(found)
            found, size = [], 0
    if found:
        yield from _deal(found)
    release()


def _cut_out(data, at, ids, asked, part):
    """The asked-for fragments of some rows: key, hash, id, text key, place, windows, bytes, bounds."""
    row, a, b, h = anchors(data, at)
    key = _text_key(data, at, part)
    cuts = np.searchsorted(row, np.arange(at.size))
    pick, hot = np.zeros(row.size, bool), np.zeros(row.size, bool)
    for k in range(at.size - 1):
        lo, hi = cuts[k], cuts[k + 1]
        want = np.array(asked[k] or [], np.int64).view(np.uint64)
        if hi > lo and want.size:
            pick[lo:hi] = np.isin(h[lo:hi], want & ~np.uint64(1))
            warm = want[(want & np.uint64(1)) > 0] & ~np.uint64(1)
            if warm.size:
                hot[lo:hi] = np.isin(h[lo:hi], warm)
    cold = pick & ~hot
    hot &= pick
    n = (b - a + 1)[hot]
    each = np.repeat(a[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]) if n.size else a[hot], n) + np.arange(n.sum())
    lo = np.concatenate([a[cold], each])
    count = np.concatenate([(b - a + 1)[cold], np.ones(each.size, np.int64)])
    hi = lo + count + WIDTH - 1
    own = span_hash(data, lo, hi)
    k = np.concatenate([h[cold], own[cold.sum() :]])
    r = np.concatenate([row[cold], np.repeat(row[hot], n)])
    raw, bounds = _gather(data, lo, hi)
    return k, own, ids[r], key[r], lo - at[r], count, raw, bounds


def _places(pos: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Places as little-endian 32-bit integers, those from bounds[k] to bounds[k + 1] in one value."""
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), pa.py_buffer(pos.astype("<i4").tobytes())])


def _read_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all rows, and how many each has."""
    raw, at = text_bytes(column)
    return np.frombuffer(raw.tobytes(), "<i4").astype(np.int64), np.diff(at) // 4


def _deal(found):
    k, own, d, t, pos, n = (np.concatenate([f[i] for f in found]) for i in range(6))
    size = np.concatenate([np.diff(f[7]) for f in found])
    raw = np.concatenate([f[6] for f in found])
    bounds = np.concatenate([[0], np.cumsum(size)])
    # a fragment that a smaller id of this group has too is known to be removed
    order = np.lexsort((d, own))
    lead = np.ones(own.size, bool)
    lead[1:] = own[order][1:] != own[order][:-1]
    least = np.empty(own.size, np.int64)
    least[order] = d[order][np.maximum.accumulate(np.where(lead, np.arange(own.size), 0))] if own.size else d
    known = d > least
    # known windows in a row become one
    w = np.flatnonzero(known)
    w = w[np.lexsort((pos[w], t[w], d[w]))]
    if w.size:
        new = np.ones(w.size, bool)
        new[1:] = (d[w][1:] != d[w][:-1]) | (t[w][1:] != t[w][:-1]) | (pos[w][1:] != pos[w][:-1] + n[w][:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[w], first)
        w = w[first]
        spread = mix(pos[w].astype(np.uint64) ^ (d[w].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.nulls(w.size, pa.binary()), pa.array(d[w]), pa.array(t[w]), _places(pos[w], np.arange(w.size + 1)), pa.array(total.astype(np.int32))], schema=_FRAGMENT)
    # a fragment that one text has in several places (as where words repeat) is dealt once, with its places
    dealt = np.flatnonzero(~known)
    dealt = dealt[np.lexsort((pos[dealt], own[dealt], t[dealt], d[dealt]))]
    new = np.ones(dealt.size, bool)
    new[1:] = (d[dealt][1:] != d[dealt][:-1]) | (t[dealt][1:] != t[dealt][:-1]) | (own[dealt][1:] != own[dealt][:-1])
    heads = np.append(np.flatnonzero(new), dealt.size)
    for lo in range(0, heads.size - 1, 20_000):
        some = heads[lo : lo + 20_001]
        w = dealt[some[:-1]]
        data, at = _gather(raw, bounds[w], bounds[w + 1])
        frag = pa.Array.from_buffers(pa.binary(), w.size, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(k[w].view(np.int64)), frag, pa.array(d[w]), pa.array(t[w]), _places(pos[dealt[some[0] : some[-1]]], some - some[0]), pa.array(n[w].astype(np.int32))], schema=_FRAGMENT)


def suffix_ranks(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rank of every suffix by its first WIDTH bytes within its fragment (``stops``: where each position's fragment ends).

    Larsson-Sadakane refinement: a rank is the place of its group's first suffix, so refining a group leaves the others
    alone, and groups of one suffix are never looked at again.
    """
    n = data.size
    x = eights(data, ">")
    left = stops - np.arange(n)
    short = left < 8
    x[short] &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))) - np.uint64(1))
    order = np.argsort(x)
    rank = np.empty(n, np.int64)
    sorted_x = x[order]
    lead = np.flatnonzero(np.append(True, sorted_x[1:] != sorted_x[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(lead, n))
    rank[order] = np.repeat(lead, size)
    tied = order[np.repeat(size > 1, size)]
    for ahead in (8, 16, WIDTH - 32):  # depths 16, 32 and WIDTH
        if not tied.size:
            break
        beyond = tied + ahead
        inside = beyond < stops[tied]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        order = np.argsort((rank[tied].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))  # both are below 2**32
        tied, second = tied[order], second[order]
        own = rank[tied]
        group = np.append(True, own[1:] != own[:-1])
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        place = np.arange(tied.size) - np.maximum.accumulate(np.where(group, np.arange(tied.size), 0))
        head = np.maximum.accumulate(np.where(new, np.arange(tied.size), 0))
        rank[tied] = own + place[head]
        size = np.diff(np.append(np.flatnonzero(new), tied.size))
        tied = tied[np.repeat(size > 1, size)]
    return rank


def common_prefixes(data: np.ndarray, first: np.ndarray, count: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Kasai's pass over windows: of each window in suffix order, the bytes (WIDTH at most) in common with the one before.

    ``at`` has the windows' starts, fragment by fragment (``first``, ``count``: the windows of each fragment), ``order``
    their suffix order. All fragments go side by side: a window starts from its left neighbour's prefix less one, if the
    windows one byte on are ordered the same way.
    """
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    before = np.full(order.size, -1, np.int64)
    before[order[1:]] = order[:-1]
    last = np.zeros(order.size, bool)
    last[first + count - 1] = True
    out = np.zeros(order.size, np.int64)
    lanes = np.argsort(-count, kind="stable")
    lengths = np.zeros(first.size, np.int64)
    for t in range(int(count.max()) if count.size else 0):
        lanes = lanes[: np.searchsorted(-count[lanes], -t, "left")]
        w = first[lanes] + t
        q = before[w]
        if t:
            was = before[w - 1]
            follows = (was >= 0) & ~last[was]
            follows &= place[np.where(follows, was + 1, 0)] < place[w]
            lengths[lanes] = np.where(follows, np.maximum(lengths[lanes] - 1, 0), 0)
        lengths[lanes[q < 0]] = 0
        going = np.flatnonzero((q >= 0) & (lengths[lanes] < WIDTH))
        while going.size:
            l = lengths[lanes[going]]
            same = data[at[w[going]] + l] == data[at[q[going]] + l]
            going = going[same]
            lengths[lanes[going]] += 1
            going = going[lengths[lanes[going]] < WIDTH]
        out[w] = lengths[lanes]
    return out[order]


class Shard:
    """The windows of some fragments, sorted, with the smallest id of each distinct one."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, ids: np.ndarray, count: np.ndarray):
        # equal fragments are sorted once, with the smallest of their ids
        whole = span_hash(raw, bounds[:-1], bounds[1:])
        _, some, back = np.unique(whole, return_index=True, return_inverse=True)
        least = np.full(some.size, NO_ID, np.int64)
        np.minimum.at(least, back, ids)
        self.all_ids, self.all_counts, self.back, self.counts = ids, count, back, count[some]
        raw, bounds = _gather(raw, bounds[some], bounds[some + 1])
        count, stops = count[some], np.repeat(bounds[1:], np.diff(bounds))
        rank = suffix_ranks(raw, stops)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        self.first, self.starts = first, np.repeat(bounds[:-1] - first, count) + np.arange(count.sum())
        order = np.argsort(rank[self.starts], kind="stable")
        prefix = common_prefixes(raw, first, count, order, self.starts)
        head = prefix < WIDTH
        head[:1] = True
        heads = np.flatnonzero(head)
        self.group = np.empty(order.size, np.int64)
        self.group[order] = np.cumsum(head) - 1
        self.least = np.minimum.reduceat(np.repeat(least, count)[order], heads) if order.size else np.zeros(0, np.int64)
        self.raw, self.heads = raw, self.starts[order[heads]]

    def sorted_windows(self) -> np.ndarray:
        """The distinct windows, ascending."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.raw, WIDTH)[self.heads]).view(f"S{WIDTH}").ravel()

    def removed(self) -> np.ndarray:
        """Of every window of every fragment, as given: whether a smaller id has it."""
        n = self.all_counts
        at = np.repeat(self.first[self.back] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.least[self.group[at]] < np.repeat(self.all_ids, n)


def merge(shards: list[Shard]) -> None:
    """Gives the distinct windows of every shard the smallest id over all shards, by binary search in each other's lists."""
    runs = [(s.sorted_windows(), s.least.copy()) for s in shards]
    for s, (mine, _) in zip(shards, runs, strict=True):
        for theirs, least in runs:
            if theirs is not mine and theirs.size:
                at = np.minimum(np.searchsorted(theirs, mine), theirs.size - 1)
                hit = theirs[at] == mine
                s.least[hit] = np.minimum(s.least[hit], least[at[hit]])


_SPAN = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _spans(d, t, places, n, removed):
    """A row for each run of removed windows of a fragment, at each of the fragment's places."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    frag = np.repeat(np.arange(n.size), n)
    window = np.arange(removed.size) - first[frag]
    before = np.append(False, removed[:-1]) & (window > 0)
    starts = np.flatnonzero(removed & ~before)
    after = np.append(removed[1:], False) & np.append(window[1:] > 0, False)
    ends = np.flatnonzero(removed & ~after)
    pos, many = places
    f = frag[starts]
    each = many[f]
    run = np.repeat(np.arange(f.size), each)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]])[f]
    at = pos[np.repeat(begin - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())] if f.size else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(d[f][run]), pa.array(t[f][run]), pa.array(at + window[starts][run]), pa.array(at + window[ends][run] + WIDTH)], schema=_SPAN)


def _search(batches, bounds: Bounds | None = None):
    """Rows come sorted by k. Whole keys fill a shard; a key that is larger than a shard is cut and merged."""
    held: list[pa.RecordBatch] = []
    most = (bounds or Bounds()).shard_bytes
    size, limit = 0, most

    def arrays(rows: pa.RecordBatch):
        return (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "t", "n"))

    def work(rows: pa.RecordBatch):
        if not rows.num_rows:
            return
        key = rows.column("k").to_numpy()
        if key[0] == key[-1] and rows.column("frag").nbytes > 2 * most:
            rows, spans = folded(rows)
            yield spans
        raw, at = text_bytes(rows.column("frag"))
        d, t, n = arrays(rows)
        if raw.size <= 2 * most or key[0] != key[-1]:
            yield _spans(d, t, _read_places(rows.column("pos")), n, Shard(raw, at, d, n).removed())
            return
        cuts = [0]
        while cuts[-1] < n.size:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + most, "right")) - 1))
        cuts[-1] = n.size
        shards = [Shard(raw[at[a] : at[b]], at[a : b + 1] - at[a], d[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        merge(shards)
        for s, a, b in zip(shards, cuts, cuts[1:], strict=False):
            yield _spans(d[a:b], t[a:b], _read_places(rows.column("pos").slice(a, b - a)), n[a:b], s.removed())

    def folded(rows: pa.RecordBatch):
        """Of one key's rows, those that no equal fragment of a smaller id beats, once each; spans of the others."""
        raw, at = text_bytes(rows.column("frag"))
        d, t, n = arrays(rows)
        own = span_hash(raw, at[:-1], at[1:])
        order = np.lexsort((t, d, own))
        new = np.append(True, own[order][1:] != own[order][:-1])
        least = d[order][np.maximum.accumulate(np.where(new, np.arange(order.size), 0))]
        beaten = d[order] > least
        lost = order[beaten]
        many = n[lost]
        pos, each = _read_places(rows.column("pos").take(pa.array(lost)))
        spans = _spans(d[lost], t[lost], (pos, each), many, np.ones(int(many.sum()), bool))
        # the others have the least id: those that repeat id, text and places as well say nothing more
        twins = new | (d[order] != np.append(-1, d[order][:-1])) | (t[order] != np.append(0, t[order][:-1]))
        twins |= own[order] != np.append(np.uint64(0), own[order][:-1])
        places = rows.column("pos").take(pa.array(order)).to_pylist()
        twins |= np.array([True, *(a != b for a, b in zip(places[1:], places, strict=False))])
        return rows.take(pa.array(np.sort(order[~beaten & twins]))), spans

    def one(parts_: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts_).combine_chunks().to_batches()[0] if len(parts_) > 1 else parts_[0]

    for batch in batches:
        dealt = batch.column("frag").is_valid()
        sure = batch.filter(pa.compute.invert(dealt))
        if sure.num_rows:
            d, t, n = arrays(sure)
            pos, _ = _read_places(sure.column("pos"))  # one place each
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(pos), pa.array(pos + n + WIDTH - 1)], schema=_SPAN)
        batch = batch.filter(dealt)
        if batch.num_rows:
            held.append(batch)
            size += batch.column("frag").nbytes
        if size > limit:
            rows = one(held)
            key = rows.column("k").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield from work(rows.slice(0, whole))
                rows = rows.slice(whole)
            if rows.column("frag").nbytes > most:  # one key
                rows, spans = folded(rows)
                yield spans
            held, size = [rows], rows.column("frag").nbytes
            limit = max(most, 2 * size)  # what is left of a large key is looked at again when it has doubled
    if held:
        # what is left: keys that fill one shard, then perhaps a last large key
        rows = one(held)
        key = rows.column("k").to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        yield from work(rows.slice(0, whole))
        yield from work(rows.slice(whole))
    release()


def _clean(batches):
    """Of each text, what is left without its spans."""
    bound = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in _unpack(batches):
        for part, data, at in steps(batch, "text", STEP_BYTES):
            key, spans = _text_key(data, at, part), part.column("spans")
            row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
            t, start, end = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("t", "start", "end"))
            mine = t == key[row]
            row, start, end = row[mine], start[mine], end[mine]
            change = np.bincount(at[row] + start, minlength=data.size + 1) - np.bincount(at[row] + end, minlength=data.size + 1)
            gone = np.cumsum(change[:-1]) > 0
            opens, shuts = gone.copy(), gone.copy()
            inner = at[(at > 0) & (at < data.size)]
            opens[1:] &= ~gone[:-1]
            shuts[:-1] &= ~gone[1:]
            opens[inner] = gone[inner]
            shuts[inner - 1] = gone[inner - 1]
            a, b = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
            first = np.searchsorted(a, at)
            home = np.repeat(np.arange(part.num_rows), np.diff(first))
            removed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - at[home]), pa.array(b - at[home])], fields=list(bound)))
            left = np.concatenate([[0], np.cumsum(~gone)])[at]
            kept, whole = data[~gone].tobytes(), data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("u"), pa.array([hashlib.sha256(whole[x:y]).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    pa.array(np.diff(at) - np.diff(left)), removed, pa.array([kept[x:y] for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)], pa.binary()),
                ],
                names=["id", "u", "digest", "n_removed", "removed", "kept"],
            )
        release()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, bounds: Bounds | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, removed (spans of bytes), kept_sha256 and, with ``texts``, kept
    (the remaining bytes; null where the whole text stays).
    """
    bounds = bounds or Bounds()
    small_batches(docs.sparkSession)
    whole_text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # u spreads and tells apart documents that have no id, by their texts
    own = F.when(F.col("id") == NO_ID, F.xxhash64("text", F.lit(1))).otherwise(F.lit(0)).cast("long").alias("u")
    rows = docs.select(F.col(id_col).cast("long").alias("real"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole_text.alias("text")).select("*", own)
    base = cut(rows.select("real", "id", "u", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = cut(base.groupBy("digest").agg(F.min("id").alias("least")))  # cut, so that a hot digest's join can be split
    marked = cut(base.join(firsts, "digest").withColumn("copy", F.col("id") > F.col("least")).drop("least"))
    # only first copies go on; texts that share an id are told apart by a key that other rows go without
    whole = marked.groupBy("id", "u").agg(F.min("copy").alias("copy"), F.max("n_bytes").alias("n_bytes"), (F.min("digest") != F.max("digest")).alias("twin"))
    alive = cut(whole.filter(~F.col("copy") & (F.col("n_bytes") >= WIDTH)).select("id", "u", "twin", "n_bytes"))
    n = max(parts(docs), math.ceil((alive.agg(F.sum("n_bytes")).first()[0] or 0) / bounds.part_bytes))
    alive, key = alive.drop("n_bytes"), ["id", "u"]
    dealt = rows.select("id", "u", "text").mapInArrow(_pack, "id long, u long, z binary, n int").repartition(n, *key)  # this shuffle of the texts serves all three passes over them
    routed = dealt.join(alive, key).select("id", "u", "z", "n").mapInArrow(partial(_route, bounds=bounds), "k long, x long, d long, u long").repartition(n, "k")
    shared = routed.mapInArrow(partial(_shared, bounds=bounds), "d long, u long, h long")
    lists = shared.groupBy(F.col("d").alias("id"), "u").agg(F.collect_list("h").alias("hs")).join(alive, key)
    fragments = dealt.join(lists, key).select("id", "u", "z", "n", "hs", "twin").mapInArrow(partial(_fragments, bounds=bounds), "k long, frag binary, d long, t long, pos binary, n int")
    found = fragments.repartition(n, "k").sortWithinPartitions("k").mapInArrow(partial(_search, bounds=bounds), "id long, t long, start long, end long")
    spans = found.groupBy("id", F.when(F.col("id") == NO_ID, F.col("t")).otherwise(F.lit(0)).alias("u")).agg(F.collect_list(F.struct("t", "start", "end")).alias("spans"))
    touched = dealt.join(spans.join(alive, key), key).select("id", "u", "z", "n", "spans", "twin").mapInArrow(_clean, "id long, u long, digest binary, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary")
    touched = touched.filter("n_removed > 0")
    if not texts:
        touched = touched.withColumn("kept", F.unhex(F.sha2("kept", 256)))
    touched = touched.groupBy(*key, "digest").agg(*(F.first(c).alias(c) for c in ("n_removed", "removed", "kept")))
    gone = F.col("copy") & (F.col("n_bytes") >= WIDTH)
    hashed = F.sha2("kept", 256) if texts else F.lower(F.hex("kept"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = marked.join(touched, [*key, "digest"], "left").select(
        F.col("real").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, all_of_it).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("removed"),
        F.when(gone, F.sha2(F.lit(b""), 256)).when(F.col("kept").isNotNull(), hashed).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    return out


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
