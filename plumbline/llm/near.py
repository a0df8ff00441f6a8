"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words: runs of bytes other than ASCII white space); two are linked when their
sets' Jaccard similarity is 0.8 or more. One Arrow pass hashes words and shingles by array operations and gives each
text its MinHash bands. Then:

1. Texts with the same shingle set are one class, represented by its smallest row; classes have a size, and only
   representatives go on.
2. Representatives that share a band key form candidate components. Components come from edges to the smallest member
   of each band bucket (never from all pairs), by a distributed min-label propagation with pointer jumping.
3. A component's members travel to a task with their MinHash values and shingle hashes, computed once; components of
   more than ``BLOCK`` members or ``BLOCK_BYTES`` of shingles are dealt in blocks, each pair of blocks to a task of its
   own, so work and memory of a task are bounded at every size. Its blocks hold texts of like length: sets whose sizes
   differ by more than the threshold allows cannot be linked, and their blocks never meet. There candidate pairs (equal in some band) meet the
   BayesLSH test: values are compared ``CHUNK`` at a time, and a pair is dropped once the posterior probability that its
   similarity reaches the threshold is below ``TOLERANCE``; the others are verified on their whole shingle sets by whole
   numbers. Pairs never become rows: a task returns for each text the number of linked texts, and links that span its
   linked groups.
4. Verified links give the groups (the same propagation) and every text its number of links.

Bands have ``ROWS`` values, and there are ``BANDS`` of them: a pair at similarity 0.8 is missed with probability
(1 - 0.8**ROWS)**BANDS = 7.4e-7 by the bands and TOLERANCE-like by the pruning, while texts that merely share some lines
seldom meet (0.38 at similarity 0.5, 0.09 at 0.4), which keeps components near the groups they contain. What remains
quadratic is the count of links itself: m different texts of like length in one component are compared pair by pair, and
each of them is dealt some 3 m / BLOCK times.

Nulls: a null text is empty; texts without words link to nothing and are classes of their own; a text with fewer than
five words is one shingle of all its words. Repeated rows and equal texts are members of one class, each linked to the
others. A null id keeps its row and ranks after all others. Ties: of a class or group with several rows of the smallest
id, the first row read stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, extend, keep_rows, mix, parts, release, small_batches, span_hash, steps, table, word_bounds

N, THRESHOLD = 5, 0.8
ROWS, BANDS = 7, 60
#: MinHash values compared at a time, and the posterior probability under which a pair is dropped.
CHUNK, TOLERANCE = 35, 1e-7
#: Members of a block, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: More than the blocks of one length that a component may have.
UNITS = 1 << 32
#: Shingles side by side in one step of the block verification.
COLUMNS = 4096
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every row."""
    starts, ends, first = word_bounds(data, at)
    words = span_hash(data, starts, ends)
    run = np.zeros(max(0, words.size - n + 1), np.uint64)
    for k in range(n):
        run = mix(run * np.uint64(3) + words[k : k + run.size])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(run[lo : hi - n + 1]))
        elif hi > lo:
            few = np.zeros(1, np.uint64)
            for w in words[lo:hi]:
                few = mix(few * np.uint64(5) + w)
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(grams: np.ndarray) -> np.ndarray:
    """The top 32 bits of the least value under each of the multiplicative permutations."""
    best = np.full(_SEEDS.size, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, grams.size, 512):
        part = grams[lo : lo + 512]
        np.minimum(best, (part[None, :] * _SEEDS[:, None]).min(1), out=best)
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(3) + values[k::ROWS].astype(np.uint64) + np.uint64(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _set_key(g: np.ndarray) -> bytes | None:
    """128 bits that stand for a shingle set; none for the empty one."""
    return np.array([g.sum(), np.bitwise_xor.reduce(mix(g + np.uint64(7)))], np.uint64).tobytes() if g.size else None


def _sketch(part, data, at):
    found = shingles(data, at)
    bands = [band_keys(minhash(g)).view(np.int64) if g.size else g.view(np.int64) for g in found]
    return [pa.array([_set_key(g) for g in found], pa.binary()), pa.array([g.size for g in found], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]


_MEMBER = ("comp", "unit", "pairs", "row", "size")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with their sets' shingle hashes and MinHash values. Rows that repeat a member's text are passed over."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for row in batch.column("row").to_pylist():
            fresh.append(row not in seen)
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(row)
        batch = batch.filter(pa.array(fresh))
        for part, data, at in steps(batch, "text"):
            found = shingles(data, at)
            mine = [k for k, (g, own) in enumerate(zip(found, part.column("set").to_pylist(), strict=True)) if _set_key(g) == own]
            part = part.take(pa.array(mine, pa.int64()))
            found = [found[k] for k in mine]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _MEMBER), pa.array([minhash(g).tobytes() for g in found], pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())], names=[*_MEMBER, "sketch", "grams"])
        release()


def components(nodes_edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) is connected with.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node's larger neighbours, then its smaller
    ones, are tied to the smallest node around. Each step is two shuffles with partial aggregation and is cut to the
    shared folder. So are the minima that it joins with: both sides of the join are then plain shuffles, which Spark
    splits where a hub's neighbours meet. It ends when every node is tied to its smallest and to no other.
    """
    edges = cut(nodes_edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        low = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        # a node with one smaller neighbour is where it belongs; the others' neighbours are tied to the smallest
        torn = cut(low.filter("n > 1").select("a", "m"))
        if torn.isEmpty():
            edges = large
            # every node is tied to one other: done when that other is tied to none
            if edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
                break
        else:
            small = large.join(torn, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
            edges = cut(small.filter("a > b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values (multiples of CHUNK), the fewest matches that keep a pair.

    With a uniform prior, the similarity's posterior after m matches in n is Beta(m+1, n-m+1); the chance that it is at
    least t equals that of at most m successes in n+1 trials with chance t.
    """
    out = []
    for n in range(CHUNK, ROWS * BANDS + 1, CHUNK):
        below, m = 0.0, -1
        while m < n:
            below += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m + 1)
    return tuple(out)


def _candidates(keys_a: np.ndarray, keys_b: np.ndarray) -> np.ndarray:
    """Whether each pair is equal in some band."""
    hit = np.zeros((keys_a.shape[0], keys_b.shape[0]), bool)
    for k in range(keys_a.shape[1]):
        hit |= keys_a[:, k, None] == keys_b[None, :, k]
    return hit


def _prune(i: np.ndarray, j: np.ndarray, va: np.ndarray, vb: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs the incremental comparison keeps."""
    alive = np.arange(i.size)
    matches = np.zeros(i.size, np.int32)
    for step, least in enumerate(least_matches(threshold)):
        cols = slice(step * CHUNK, (step + 1) * CHUNK)
        for lo in range(0, alive.size, 1 << 16):
            k = alive[lo : lo + (1 << 16)]
            matches[k] += (va[i[k], cols] == vb[j[k], cols]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def _members(positions: list[np.ndarray], lo: int) -> np.ndarray:
    """Which of COLUMNS shingles from ``lo`` on each text has."""
    out = np.zeros((len(positions), COLUMNS), np.float32)
    for r, p in enumerate(positions):
        a, b = np.searchsorted(p, (lo, lo + COLUMNS))
        out[r, p[a:b] - lo] = 1
    return out


def _verify(i: np.ndarray, j: np.ndarray, sa: list[np.ndarray], sb: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the pairs' whole shingle sets have the similarity."""
    na, nb = np.array([s.size for s in sa]), np.array([s.size for s in sb])
    if i.size < 4 * (len(sa) + len(sb)):
        both = np.array([np.intersect1d(sa[x], sb[y], assume_unique=True).size for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:  # many pairs of few texts: intersections of all of them by products of membership matrices, some columns at a time
        same = sa is sb
        grams = np.unique(np.concatenate(sa if same else [*sa, *sb]))
        where = lambda sets: [np.searchsorted(grams, s) for s in sets]
        pa_ = where(sa)
        pb_ = pa_ if same else where(sb)
        count = np.zeros((len(sa), len(sb)), np.int64)
        for lo in range(0, grams.size, COLUMNS):  # whole numbers up to COLUMNS are exact in a product
            ma = _members(pa_, lo)
            count += (ma @ (ma if same else _members(pb_, lo)).T).astype(np.int64)
        both = count[i, j]
    # x / y >= t for whole numbers, with t as written: 0.8 means four fifths
    union = na[i] + nb[j] - both
    return both >= np.ceil(threshold * union - 1e-9)


def links(keys_a, va, sa, keys_b=None, vb=None, sb=None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked texts of two blocks, or of one (then i < j)."""
    own = keys_b is None
    keys_b, vb, sb = (keys_a, va, sa) if own else (keys_b, vb, sb)
    hit = _candidates(keys_a, keys_b)
    i, j = np.nonzero(np.triu(hit, 1) if own else hit)
    kept = _prune(i, j, va, vb, threshold)
    i, j = i[kept], j[kept]
    good = _verify(i, j, sa, sb, threshold)
    return i[good], j[good]


_FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect: at most one for each text."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _join_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a component and pair of blocks come one after another (the partition is sorted)."""
        held, at = [], None

        def done():
            if not held:
                return
            ids, sizes = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            block = np.array([h[2] for h in held])
            grams = [np.frombuffer(h[3], np.uint64) for h in held]
            values = np.stack([np.frombuffer(h[4], np.uint32) for h in held])
            keys = np.stack([band_keys(v) for v in values])
            split = int((block == block[0]).sum())
            if at[1] == at[2]:
                i, j = links(keys, values, grams, threshold=threshold)
            elif split == block.size:
                return
            else:
                i, j = links(keys[:split], values[:split], grams[:split], keys[split:], values[split:], grams[split:], threshold)
                j = j + split
            n = np.bincount(i, sizes[j], ids.size) + np.bincount(j, sizes[i], ids.size)
            rows = [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n)] + [(x, y, 0) for x, y in _spanning(ids[i], ids[j])]
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(3)], schema=_FOUND)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "row", "size", "block", "grams", "sketch")]
            for comp, i, j, row, size, block, grams, sketch in zip(*cols, strict=True):
                if (comp, i, j) != at:
                    yield from done()
                    held, at = [], (comp, i, j)
                if not held or held[-1][0] != row:  # a repeated row brings its text again
                    held.append((row, size, block, grams, sketch))
        yield from done()
        release()

    return run


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id, class_size, n_links, group_id.

    class_id is the smallest id of the rows with the same shingle set, group_id that of the rows that links connect,
    n_links the number of other rows that the row is linked to. ``kept`` marks one row of each group, and ``text_key``
    is a hash of the text, which tells rows of one id apart.
    """
    n = parts(docs)
    small_batches(docs.sparkSession)
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("*", text_key)
    sketch = cut(extend(rows, lambda: _sketch, "set binary, n_grams long, bands array<long>", "text", STEP_BYTES, ("text",)))
    # 1. classes: one hash grouping with partial aggregation; a text without words is a class of its own
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "text_key", "n_grams")
    classes = sketch.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    classes = cut(classes.select("set", F.col("first.row").alias("rep"), F.col("first.id").alias("rep_id"), F.col("first.text_key").alias("rep_key"), F.col("first.n_grams").alias("n_grams"), "size"))
    # 2. candidate components of representatives
    reps = sketch.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", F.explode("bands").alias("key"))
    # (here and below, what is joined with is cut first: Spark splits a hot key of a join between plain shuffles only)
    buckets = cut(reps.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    pairs = reps.join(buckets.select("key", "least"), "key").filter("row > least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    comps = cut(components(pairs))
    # 3. members with their shingles, once, or once for each pair of blocks of a large component
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_grams") * 8) / BLOCK_BYTES)).cast("int").alias("blocks")
    members = comps.join(classes.withColumnRenamed("rep", "node"), "node")
    sizes = cut(members.groupBy("label").agg(blocks))
    # sets of a threshold or more in common are of the same length class or of neighbouring ones (the base is a little
    # wider than the threshold, so that rounding parts none)
    length = F.when(F.col("blocks") > 1, F.floor(F.ln("n_grams") / math.log(1.01 / threshold))).otherwise(0).cast("int")
    # (cut, so that the grouping adds up within partitions first, rather than where the join has dealt a hot label)
    members = cut(members.join(sizes, "label").withColumn("length", length).drop("blocks"))
    dealt_in = members.groupBy("label", "length").agg(blocks).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("length", "blocks"))).alias("of"))  # few lengths: a logarithm
    own = F.pmod(F.xxhash64("node"), F.col("of")[F.col("length")]).cast("int")
    unit = lambda length, block: length * UNITS + block
    met = F.flatten(F.transform(F.array(*(F.col("length") + d for d in (-1, 0, 1))), lambda n: F.when(F.map_contains_key("of", n), F.transform(F.sequence(F.lit(0), F.col("of")[n] - 1), lambda k: unit(n.cast("long"), k))).otherwise(F.array().cast("array<bigint>"))))
    members = members.join(cut(dealt_in), "label").withColumn("unit", unit(F.col("length").cast("long"), own)).withColumn("pairs", met)
    members = cut(members.select(F.col("node").alias("row"), F.col("label").alias("comp"), "unit", "pairs", "rep_id", "rep_key", "size", "set"))
    # texts are found by id and text hash and told apart by their set, so that nothing rests on row numbers of a second scan
    texts = rows.select("id", "text_key", "text").join(members, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))
    grams = texts.select(*_MEMBER, "set", "text").mapInArrow(_grams, "comp long, unit long, pairs array<long>, row long, size long, sketch binary, grams binary")
    turn = F.transform("pairs", lambda k: F.struct(F.least(k, F.col("unit")).alias("i"), F.greatest(k, F.col("unit")).alias("j")))
    dealt = grams.withColumn("pair", F.explode(turn)).select("comp", "pair.i", "pair.j", "row", "size", F.col("unit").alias("block"), "grams", "sketch")
    dealt = dealt.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "block", "row")
    found = cut(dealt.mapInArrow(_join_blocks(threshold), "node long, other long, links long"))
    # 4. groups and numbers of links
    groups = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    linked = cut(classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(counted.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    firsts = cut(linked.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep")).alias("g")))
    known = linked.join(firsts, "label").select("set", "rep", "rep_id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.col("g.rep_id").alias("group"), F.col("g.rep").alias("keeper"))
    alone = F.col("rep").isNull()
    return sketch.select("row", "id", "set", "text_key").join(known, "set", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("rep_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("group")).alias("group_id"),
        (alone | (F.col("row") == F.col("keeper"))).alias("kept"),
        "text_key",
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of linked rows."""
    found = similarity_join(docs, id_col, text_col, threshold)
    return keep_rows(docs, found.select(F.col(id_col).alias("id"), F.col("text_key").alias("key"), "kept"), id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).drop("text_key")
