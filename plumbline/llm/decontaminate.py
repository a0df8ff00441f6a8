"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

A document leaks an item when some part of it is within ``floor(RATIO * length)`` edits (insertions, deletions,
substitutions of characters) of the whole item, capitals (ASCII and Latin-1) and kinds of white space aside. Per document:

1. Walks: an item, and an item-sized window of a text, go through random walks (CGK): a step emits the character at the
   cursor, which a random bit of (step, character) then moves on or leaves. Walks of texts at a small edit distance fall
   into step again, so edit distance becomes Hamming distance.
2. Buckets: bit sampling looks at ``BITS`` places of a walk, in as many repetitions as the target recall asks for. The
   items' buckets are a table; a window is a candidate for every item of its length that it shares a bucket with.
3. Candidates are verified exactly by bit-parallel alignment of the item anywhere in the window and k characters around
   it. The least number of edits is returned, with its place; of equal ones the first.

Windows are opened where a text can hold a leak at all, not at every character: an item with k edits allowed is cut into
k + s pieces; an edit touches one of them at most, so s survive (``SUPPORT``; fewer for short items), and their places in
the text imply window starts that lie close together. One pass of array operations finds the pieces' first bytes, and
windows open at each implied start that s different pieces of some item support, which loses no leak. Which items a
window is held against is decided by the buckets alone.

The items are few: they travel to the tasks in blocks of some ``ITEM_CHARS`` characters, of which each item counts
``ITEM_COST`` more than it has, so that an index of many small ones stays within ``INDEX_BYTES`` too. A block's index is
built once, of sorted arrays, and its size is checked before it is broadcast. Each further block is a pass and a written
table of its own, one broadcast at a time, so that memory stays bounded at any size of the benchmark. With one block,
documents are never shuffled or written.

Equal windows of a batch of documents are walked and aligned once, and texts are searched by stretches of
``STRETCH_BYTES`` that overlap by what a leak can take, so that neither repeats nor length are a burden.

Nulls: a null text leaks nothing; items of null or (if short) blank text are not searched; items of null id leak with
a null ``item_id``. Items shorter than ``LEAST`` characters are searched exactly, between word bounds. Items of one text
are all returned. Repeated rows are searched one by one, texts of any length as a whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, STEP_BYTES, cut, eights, extend, lower, mix, packed, steps, table

RATIO, LEAST = 0.1, 8
#: Pieces that must survive, and the numbers of a piece's first bytes that are looked up (the largest that fits).
SUPPORT, SEEDS = 4, (8, 6, 4, 2, 1)
#: Places that one repetition samples, and the share of differing places in a walk that must still be found.
BITS, FAR = 3, 0.6
RECALL, WALKS = 0.99, 8
ITEM_CHARS, ITEM_COST = 4 << 20, 100
INDEX_BYTES = 256 << 20
GROUP_BYTES = 8 * STEP_BYTES
LOOK_BYTES = 1 << 15
STRETCH_BYTES = 1 << 20
#: Windows that wait for their walks at a time, and characters that are walked side by side.
WINDOWS, WALKED = 1 << 14, 1 << 20
_TYPE = "array<struct<item_id:long,edits:int,start:int,end:int>>"


def repetitions(far: float = FAR, bits: int = BITS, recall: float = RECALL) -> int:
    """How many samples find a pair that differs in a share ``far`` of its places with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - far) ** bits))


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Small letters and one kind of blank, byte by byte: places stay where they are."""
    out = lower(data)
    out[BLANK[out]] = 32
    return out


def plain(text: str) -> str:
    return plain_bytes(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(texts: list[np.ndarray], seed: int) -> np.ndarray:
    """The CGK walks of the texts, one row each, of three times the longest text's steps; 0 after a text's end."""
    most = max((t.size for t in texts), default=0)
    padded = np.zeros((len(texts), most + 1), np.uint32)
    for k, t in enumerate(texts):
        padded[k, : t.size] = t + 1
    at, rows = np.zeros(len(texts), np.int64), np.arange(len(texts))
    out = np.zeros((len(texts), 3 * most), np.uint32)
    for step in range(3 * most):
        c = padded[rows, at]
        out[:, step] = c
        bit = (c.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64((seed * 1_000_003 + step) * 2 + 1 & (1 << 64) - 1)
        at = np.minimum(at + (mix(bit) >> np.uint64(63)).astype(np.int64), most)
    return out


def _slot(v: np.ndarray) -> np.ndarray:
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _supported(starts: list[int], pieces: list[int], reach: int, need: int) -> list[int]:
    """The distinct starts (ascending) that ``need`` different pieces within ``reach`` of each other imply."""
    out: list[int] = []
    held: dict[int, int] = defaultdict(int)
    lo = done = 0
    for hi, s in enumerate(starts):
        held[pieces[hi]] += 1
        while starts[lo] < s - reach:
            held[pieces[lo]] -= 1
            if not held[pieces[lo]]:
                del held[pieces[lo]]
            lo += 1
        if len(held) >= need:
            out += [x for x in starts[max(lo, done) : hi + 1] if not out or x != out[-1]]
            done = hi + 1
    return sorted(set(out))


class Items:
    """What is searched: pieces for the pass over the text, buckets of sampled walks, and masks for the alignment."""

    def __init__(self, items: list[tuple[int, str]], ratio: float = RATIO):
        ids: dict[str, list[int | None]] = defaultdict(list)
        for i, text in items:
            if text and (len(text) >= LEAST or plain(text).strip()):
                ids[plain(text) if len(text) >= LEAST else plain(text).strip()].append(i)
        self.texts = sorted(t for t in ids if len(t) >= LEAST)
        short = sorted(t for t in ids if len(t) < LEAST)
        self.short = {t: n for n, t in enumerate(short, len(self.texts))}  # searched exactly; numbered after the others
        self.lengths = sorted({len(t) for t in short})
        self.ids = [sorted(ids[t], key=lambda i: (i is None, i or 0)) for t in (*self.texts, *short)]
        self.edits = [int(ratio * len(t) + 1e-9) for t in self.texts]
        self.support = [SUPPORT if len(t) >= 60 else 2 for t in self.texts]
        # seeds: for each width, the first bytes of every piece, and which items have them where
        found: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (text, k, s) in enumerate(zip(self.texts, self.edits, self.support, strict=True)):
            cuts = [len(text) * j // (k + s) for j in range(k + s + 1)]
            least = min(b - a for a, b in zip(cuts, cuts[1:], strict=False))
            width = next(w for w in SEEDS if w <= max(least, SEEDS[-1]))
            for j, a in enumerate(cuts[:-1]):
                seed = text[a:].encode()[:width]
                found[width][int.from_bytes(seed, "little") << (64 - 8 * width)].append((n, len(text[:a].encode()), j))
        self.seeds = {}
        for width, by in found.items():
            values = sorted(by)
            first = np.concatenate([[0], np.cumsum([len(by[v]) for v in values])])
            self.seeds[width] = (np.array(values, np.uint64), first, np.array([x for v in values for x in by[v]], np.int32).reshape(-1, 3))
        #: Bytes from a leak's begin to the end of its last piece, and as much again as edits may move it.
        self.span = max((len(t.encode()) + 8 * k for t, k in zip(self.texts, self.edits, strict=True)), default=0) + 8
        per_walk = -(-repetitions() // WALKS)
        random = np.random.default_rng(20_240_601)
        self.samples = random.random((WALKS, per_walk, BITS))  # places, as shares of a walk's length
        keys = self.keys([codes(t) for t in self.texts])
        order = np.argsort(keys, axis=None, kind="stable")
        self.buckets = keys.ravel()[order], (order // max(1, keys.shape[1])).astype(np.int32)  # sorted keys, which tell lengths apart, and their items
        self._held: dict[int, tuple[dict[str, int], dict[str, int]]] = {}  # masks of the items aligned last

    def nbytes(self) -> int:
        """What the index holds in arrays and texts."""
        arrays = sum(a.nbytes for one in self.seeds.values() for a in one) + sum(a.nbytes for a in self.buckets)
        return arrays + sum(4 * len(t) for t in self.texts)

    def _maybe(self, width: int) -> np.ndarray:
        """Which slots some seed of the width has: made where it is first asked for, it does not travel."""
        if not hasattr(self, "_slots"):
            self._slots = {}
        if width not in self._slots:
            self._slots[width] = np.zeros(1 << 22, bool)
            self._slots[width][_slot(self.seeds[width][0])] = True
        return self._slots[width]

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for j, c in enumerate(text):
            out[c] |= 1 << j
        return dict(out)

    def keys(self, texts: list[np.ndarray]) -> np.ndarray:
        """The bucket of every text in every repetition; texts of different lengths share none."""
        size = np.array([t.size for t in texts], np.int64)
        order = np.argsort(size, kind="stable")
        per_walk = self.samples.shape[1]
        out = np.empty((len(texts), WALKS * per_walk), np.uint64)
        lo = 0
        while lo < order.size:  # texts of like length, so that the longest does not set the width of all
            hi = lo + 1
            while hi < order.size and size[order[hi]] * (hi + 1 - lo) <= WALKED and size[order[hi]] <= 2 * size[order[lo]] + 64:
                hi += 1
            group = order[lo:hi]
            own, rows = size[group], np.arange(group.size)
            for w in range(WALKS):
                walked = walk([texts[k] for k in group], w)
                for q, places in enumerate(self.samples[w]):
                    key = mix(own.astype(np.uint64) * np.uint64(WALKS * per_walk) + np.uint64(w * per_walk + q))
                    for p in places:
                        # a walk of n characters is over after some 2 n steps, so places lie within those
                        key = mix(key * np.uint64(3) + walked[rows, (p * 2 * own).astype(np.int64)])
                    out[group, w * per_walk + q] = key
            lo = hi
        return out

    def candidates(self, windows: list[str], length: list[int]) -> list[list[int]]:
        """For each window of so many characters (fewer at a text's end), the items that share a bucket with it."""
        keys = self.keys([codes(w.ljust(m, "\0")) for w, m in zip(windows, length, strict=True)])
        held, items = self.buckets
        lo = np.searchsorted(held, keys)
        row, at = np.nonzero(held[np.minimum(lo, held.size - 1)] == keys)
        lo, hi = lo[row, at], np.searchsorted(held, keys[row, at], "right")
        out: list[set[int]] = [set() for _ in windows]
        for k, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
            out[k].update(items[a:b].tolist())
        return [sorted(found) for found in out]

    def windows(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, length, start) of the windows that enough pieces of an item support, once each; lengths in characters,
        starts in bytes from the row's begin.

        ``data`` is plain. An edit moves what follows by the bytes of a character, four at most.
        """
        stretch = max(STRETCH_BYTES, self.span)
        if data.size <= stretch + self.span:
            return sorted(self._windows(data, at))
        out: set[tuple[int, int, int]] = set()
        for lo in range(0, data.size, stretch):
            hi = min(data.size, lo + stretch + self.span)
            some = np.flatnonzero((at[1:] > lo) & (at[:-1] < hi))
            if some.size:
                a, b = int(some[0]), int(some[-1])
                cuts = np.clip(at[a : b + 2] - lo, 0, hi - lo)
                off = lo + int(cuts[0]) - int(at[a])  # what of the first row lies before the stretch
                out.update((r + a, m, x + off if r == 0 else x) for r, m, x in self._windows(data[lo + cuts[0] : lo + cuts[-1]], cuts - cuts[0]))
        return sorted(out)

    def _windows(self, data: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
        """The windows of one stretch."""
        hit_of: dict[int, list] = {w: [] for w in self.seeds}
        for lo in range(0, data.size, LOOK_BYTES):  # a size whose arrays stay in the cache
            x = eights(data[lo : lo + LOOK_BYTES + 8])[:LOOK_BYTES]
            for width in self.seeds:
                v = x << np.uint64(64 - 8 * width)
                found = np.flatnonzero(self._maybe(width)[_slot(v)])
                if found.size:
                    hit_of[width].append((found + lo, v[found]))
        out: set[tuple[int, int, int]] = set()
        for width, (values, first, where) in self.seeds.items():
            if not hit_of[width]:
                continue
            hits, v = (np.concatenate(c) for c in zip(*hit_of[width], strict=True))
            place = np.minimum(np.searchsorted(values, v), values.size - 1)
            good = values[place] == v
            hits, place = hits[good], place[good]
            row = np.searchsorted(at, hits, "right") - 1
            good = hits + width <= at[row + 1]
            hits, place, row = hits[good], place[good], row[good]
            n = first[place + 1] - first[place]
            each = np.repeat(first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]) if n.size else n, n) + np.arange(n.sum())
            item, offset, piece = where[each].T.astype(np.int64)
            start = np.repeat(hits - at[row], n) - offset
            key = np.repeat(row, n) * len(self.texts) + item
            _, back, many = np.unique(key, return_inverse=True, return_counts=True)
            need = np.array(self.support)[item]
            keep = many[back] >= need if key.size else np.zeros(0, bool)
            key, start, piece = key[keep], start[keep], piece[keep]
            order = np.lexsort((piece, start, key))
            key, start, piece = key[order], start[order], piece[order]
            if not key.size:
                continue
            bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for lo, hi in zip(bounds.tolist(), np.append(bounds[1:], key.size).tolist(), strict=True):
                r, i = divmod(int(key[lo]), len(self.texts))
                out.update((r, len(self.texts[i]), s) for s in _supported(start[lo:hi].tolist(), piece[lo:hi].tolist(), 4 * self.edits[i], self.support[i]))
        return out

    def align(self, n: int, text: str) -> tuple[int, int, int]:
        """The least edits between the item and any part of the text, and that part's bounds (the first that ends)."""
        item = self.texts[n]
        if (at := text.find(item)) >= 0:
            return 0, at, at + len(item)
        if n not in self._held:
            if len(self._held) >= 256:
                self._held.clear()
            self._held[n] = self._masks(item), self._masks(item[::-1])
        masks, back = self._held[n]
        best, end = self._ends(masks, len(item), text)
        # the start: the same from the part's end backwards, with its end fixed
        part = text[max(0, end - len(item) - best) : end][::-1]
        _, length = self._ends(back, len(item), part, anchored=True)
        return best, end - length, end

    @staticmethod
    def _ends(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
        """Myers' bit vectors: the least score over all ends in the text, and the first end with it."""
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            hn, hp = up & d0, down | ~(up | d0) & full
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1) & full | anchored
            hn = (hn << 1) & full
            up, down = hn | ~(d0 | hp) & full, d0 & hp
            if score < best:
                best, end = score, j
        return best, end


_BOUND = re.compile(r"(?<!\w)|(?!\w)")


def short_places(known: Items, text: str) -> dict[int, tuple[int, int, int]]:
    """For each short item that stands in the plain text between word bounds: no edits, and its first place."""
    found: dict[int, tuple[int, int, int]] = {}
    bounds = {m.start() for m in _BOUND.finditer(text)}
    for start in sorted(bounds):
        for m in known.lengths:
            if start + m in bounds:
                n = known.short.get(text[start : start + m])
                if n is not None:
                    found.setdefault(n, (0, start, start + m))
    return found


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ratio: float = RATIO, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``leaks``: (item_id, edits, start, end) of each leaked item's best place; end exclusive, in characters."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.length("t") > 0)
    chars = wanted.agg(F.sum(F.length("t") + ITEM_COST)).first()[0] or 0
    blocks = -(-2 * chars // ITEM_CHARS) if chars > ITEM_CHARS else 1

    def searched(df: DataFrame, b: int, drop: tuple[str, ...]) -> tuple[DataFrame, object]:
        rows = [(r["i"], r["t"]) for r in wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]  # ITEM_CHARS at most, give or take
        known = Items(rows, ratio)
        if known.nbytes() > INDEX_BYTES:
            raise ValueError(f"an index of {known.nbytes()} bytes is too large to broadcast: lower ITEM_CHARS")
        held = spark.sparkContext.broadcast(known)
        return extend(df, _searcher(held, text_col), f"leaks {_TYPE}", text_col, GROUP_BYTES, drop), held

    if blocks == 1:
        return searched(docs, 0, drop)[0]
    numbered = cut(packed(docs, text_col).withColumn("row", F.monotonically_increasing_id()))
    text_col, found = "text", []
    for b in range(blocks):
        out, held = searched(numbered.select("row", "text"), b, ("text",))
        found.append(cut(out.filter(F.size("leaks") > 0)))
        held.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    kept = [c for c in docs.columns if c not in drop and c.lower() != "leaks"]
    leaks = F.coalesce("leaks", F.array().cast(_TYPE)).alias("leaks")
    return numbered.join(every, "row", "left").select(*(F.col(f"doc.`{c}`") for c in kept), leaks)


def _searcher(held, text_col: str):
    def make():
        known = held.value

        def work(part, data, at):
            found: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(part.num_rows)]
            asked: list[tuple[int, int, int, str]] = []  # row, length, the window's first character, the row's text
            aligned: dict[tuple[int, str], tuple[int, int, int]] = {}

            def answer():
                each: dict[tuple[int, str], list[int]] = defaultdict(list)  # equal windows
                for j, (_, m, first, text) in enumerate(asked):
                    each[m, text[first : first + m]].append(j)
                kinds = list(each)
                for lo in range(0, len(kinds), 2048):
                    some = kinds[lo : lo + 2048]
                    for kind, near in zip(some, known.candidates([w for _, w in some], [m for m, _ in some]), strict=True):
                        for n in near:
                            k = known.edits[n]
                            for row, m, first, text in (asked[j] for j in each[kind]):
                                origin = max(0, first - k)
                                part = text[origin : first + m + k]
                                if (n, part) not in aligned:
                                    if len(aligned) >= WINDOWS:
                                        aligned.clear()
                                    aligned[n, part] = known.align(n, part)
                                edits, start, end = aligned[n, part]
                                if edits <= k:
                                    best = (edits, origin + start, origin + end)
                                    found[row][n] = min(found[row].get(n, best), best)
                asked.clear()

            base = 0
            for some, raw, bounds in steps(part, text_col) if known.texts or known.short else ():
                small = plain_bytes(raw)
                if known.short:
                    for row in range(some.num_rows):
                        found[base + row] |= short_places(known, small[bounds[row] : bounds[row + 1]].tobytes().decode())
                texts: dict[int, tuple[str, np.ndarray]] = {}
                for row, m, start in known.windows(small, bounds) if known.texts else ():
                    if row not in texts:
                        own = small[bounds[row] : bounds[row + 1]]
                        texts[row] = own.tobytes().decode(), np.cumsum((own & 0xC0) != 0x80)
                    text, char = texts[row]
                    first = int(char[start] - 1) if start >= 0 else 0
                    asked.append((base + row, m, first, text))
                    if len(asked) >= WINDOWS:
                        answer()
                base += some.num_rows
            answer()
            rows = [[{"item_id": i, "edits": e, "start": s, "end": t} for n, (e, s, t) in sorted(f.items()) for i in known.ids[n]] for f in found]
            return [pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))]

        return work

    return make


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and leaked item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.edits", "l.start", "l.end")
