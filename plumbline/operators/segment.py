"""Temporal segmentation. A segmentation is two tables: ``assign`` (the localizations with ``segment``, -1 for none, and
``valid``), and ``segments`` (segment, start_frame, end_frame, n_locs, center_frame).

All work on rows is partitioned by frame or segment. What needs an order over all frames works on the table of frame
counts, which has a row per frame and not per localization.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BY_COUNT, BY_WINDOWS
from ..sources.scratch import cut
from .ordered import chain, next_points, numbered, running


@dataclass
class Segmentation:
    assign: DataFrame
    segments: DataFrame
    params: dict


def frame_counts(locs: DataFrame) -> DataFrame:
    """Localizations per observed frame."""
    return locs.groupBy("frame").agg(F.count("*").alias("n"))


#: The hash of a choice has 60 bits; rows are counted by the first so many of them.
_HASH_BITS, _COUNTED_BITS = 60, 12


def choice_hash(seed: int) -> Column:
    """A number for each loc_id, from a digest: the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col("loc_id").cast("string"), F.lit(str(seed)))), 1, _HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _kept(assign: DataFrame, cap: int | None, order: list[str] | None, seed: int) -> DataFrame:
    """Marks at most ``cap`` rows of each segment as valid: a reproducible random choice, or the first by ``order``.

    The choice is that of the least hashes. They are counted by segment and leading bits first; that says in which range
    of hashes a segment's last chosen row lies. Rows below that range are chosen and rows above are not, where they are;
    only those in it are put in order.
    """
    if not cap:  # None and 0 mean no cap
        return assign.withColumn("valid", F.col("segment") >= 0)
    if order:
        return _first(assign.withColumn("__left", F.lit(cap)), order).drop("__left")
    hashed = assign.withColumn("__hash", choice_hash(seed)).withColumn("__range", F.shiftright("__hash", _HASH_BITS - _COUNTED_BITS))
    counts = hashed.filter("segment >= 0").groupBy("segment", "__range").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("segment").orderBy("__range")))  # 4096 rows at most
    edge = upto.filter(F.col("upto") >= cap).groupBy("segment").agg(F.min(F.struct("__range", (F.lit(cap) - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
    both = hashed.join(edge.select("segment", F.col("e.__range").alias("__edge"), F.col("e.left").alias("__left")), "segment", "left")
    clear = both.filter("__edge IS NULL OR __range <> __edge").withColumn("valid", (F.col("segment") >= 0) & (F.col("__edge").isNull() | (F.col("__range") < F.col("__edge"))))
    close = _first(both.filter("__range = __edge"), ["__hash", "loc_id"])
    return clear.unionByName(close).drop("__hash", "__range", "__edge", "__left")


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``valid``: whether they are among the first ``__left`` of their segment."""
    at = cut(numbered(rows, ["segment", *order], "__k"))
    first = at.groupBy("segment").agg(F.min("__k").alias("__first"))
    return at.join(first, "segment").withColumn("valid", (F.col("segment") >= 0) & (F.col("__k") - F.col("__first") < F.col("__left"))).drop("__k", "__first")


def _described(assign: DataFrame, center_of_kept: bool) -> DataFrame:
    frame = F.when(F.col("valid"), F.col("frame")) if center_of_kept else F.col("frame")
    return assign.filter("segment >= 0").groupBy("segment").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_locs"), F.avg(frame).alias("center_frame")
    )


def frame_ranks(counts: DataFrame) -> DataFrame:
    """Frames numbered from 0 in their order: ``k``."""
    return counts.withColumn("k", F.row_number().over(Window.orderBy("frame")) - 1)


def by_frame_windows(locs: DataFrame, n_frames: int, cap: int | None = None, order: list[str] | None = None, seed: int = 0) -> Segmentation:
    """Windows of ``n_frames`` consecutive observed frames (gaps do not count). Centers are means before the cap."""
    ranks = frame_ranks(frame_counts(locs)).select("frame", (F.floor(F.col("k") / n_frames)).cast("int").alias("segment"))
    assign = _kept(locs.join(ranks, "frame"), cap, order, seed)
    return Segmentation(assign, _described(assign, False), {"frames_per_window": n_frames, "min_n_locs_per_window": -1})


def closes(counts: DataFrame, least: int, size: int | None = None) -> DataFrame:
    """(frame, segment) of a table of frame counts (frame, n): whole frames are collected until ``least`` localizations
    are there and as many are left; -1 for a tail that never fills a segment.

    "Left" is the whole table less the open segment only: closed segments are not taken off. So a segment that begins
    after a number of localizations ends at the first frame that holds ``least`` more, or else, where that one holds
    too much, at the last frame of all. Both are found by a search over the running counts, for every frame as a
    beginning; the beginnings that count are those met from the first frame on.
    """
    at = cut(running(counts.withColumn("__one", F.lit(1)), ["frame"], {"__upto": "n", "__k": "__one"}, size))
    total, frames = at.agg(F.coalesce(F.max("__upto"), F.lit(0)), F.coalesce(F.max("__k"), F.lit(0))).first()
    rows = at.select("frame", F.col("__upto").alias("value"), (F.col("__k") - 1).alias("id"), "n")
    found = next_points(rows.select("id", "value"), rows.select("id", (F.col("value") - F.col("n") + least).alias("value")), size, 2 * frames)
    begin = rows.select("id", (F.col("value") - F.col("n")).alias("before"))
    reached = rows.select(F.col("id").alias("found"), F.col("value").alias("reached"))
    both = begin.join(found, "id").join(reached, "found", "left")
    last = frames - 1
    close = F.when((F.col("reached") - F.col("before") <= total - least) | (F.col("found") == last), F.col("found")).when(F.col("found").isNotNull(), F.lit(last))
    pointers = cut(both.select("id", (close + 1).alias("next")))
    starts = chain(pointers, 0, size, frames).join(pointers.withColumn("tail", F.col("next").isNull()).drop("next"), "id")
    marked = rows.select("frame", "id").join(starts, "id", "left").select("frame", F.col("number").isNotNull().cast("long").alias("start"), F.coalesce(F.col("tail"), F.lit(False)).cast("long").alias("tail"))
    told = running(marked, ["frame"], {"starts": "start", "open": "tail"}, size, frames)
    return told.select("frame", F.when(F.col("open") > 0, -1).otherwise(F.col("starts") - 1).cast("int").alias("segment"))


def by_count(locs: DataFrame, least: int, cap: int | None = None, order: list[str] | None = None, seed: int = 0) -> Segmentation:
    """Whole frames are collected until ``least`` localizations are there (see ``closes``). Centers are means of what the
    cap keeps.
    """
    assign = _kept(locs.join(closes(frame_counts(locs), least), "frame"), cap, order, seed)
    return Segmentation(assign, _described(assign, True), {"frames_per_window": -1, "min_n_locs_per_window": least})


def by_windows(locs: DataFrame, n_windows: int, cap: int | None = None, order: list[str] | None = None, seed: int = 0) -> Segmentation:
    """As many windows of equal counts as come of ceil(N / n_windows) localizations each, or fewer."""
    return by_count(locs, math.ceil(locs.count() / n_windows), cap, order, seed)


def segment(locs: DataFrame, var: int, mode: int = 2, cap: int | None = None, order: list[str] | None = None, seed: int = 0) -> Segmentation:
    """By mode: 0 windows, 1 count, anything else frames."""
    how = by_windows if mode == BY_WINDOWS else by_count if mode == BY_COUNT else by_frame_windows
    return how(locs, var, cap, order, seed)


def statistics(s: Segmentation) -> DataFrame:
    """One row: numbers of segments and of localizations, valid and not, and the settings."""
    counts = s.assign.agg(F.count("*").alias("n_locs"), F.coalesce(F.sum(F.col("valid").cast("long")), F.lit(0)).cast("long").alias("n_locs_valid"), F.count_distinct(F.when(F.col("segment") >= 0, F.col("segment"))).alias("n_segments"))
    return counts.select("n_segments", "n_locs", "n_locs_valid", (F.col("n_locs") - F.col("n_locs_valid")).alias("n_locs_invalid"), *(F.lit(v).alias(k) for k, v in s.params.items()))


def relabelled(s: Segmentation) -> DataFrame:
    """Valid localizations with the segment in the frame's place."""
    return s.assign.filter("valid").select("loc_id", "x", "y", "z", F.col("segment").alias("frame"))


def by_equal_counts(locs: DataFrame, n_segments: int) -> Segmentation:
    """Cuts the rows by time into segments of floor(N / n) rows, also inside a frame; the last takes what is left over.

    A row's number is its frame's first number (from the frame counts) plus its place in the frame.
    """
    before = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    offsets = frame_counts(locs).select("frame", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    whole = locs.agg(F.count("*").alias("total"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("frame").orderBy("loc_id")) - 1
    per = F.greatest(F.floor(F.col("total") / n_segments), F.lit(1))
    assign = locs.join(offsets, "frame").crossJoin(whole).withColumn("segment", F.least(F.floor(number / per), F.lit(n_segments - 1)).cast("int"))
    assign = assign.drop("offset", "total").withColumn("valid", F.lit(True))
    return Segmentation(assign, _described(assign, False), {"frames_per_window": -1, "min_n_locs_per_window": -1})


def frames_of_segments(segments: DataFrame) -> DataFrame:
    """(frame, segment) for all frame numbers from 0: a segment reaches from the last one's end to its own end."""
    start = F.coalesce(F.lag("end_frame").over(Window.orderBy("segment")) + 1, F.lit(0))
    ends = segments.select("segment", "end_frame", start.alias("start")).filter("start <= end_frame")
    return ends.select(F.explode(F.sequence("start", "end_frame")).alias("frame"), "segment")


def cap_for(locs: DataFrame, mode: int, var: int, share: float) -> DataFrame:
    """One row: the cap per segment that keeps about ``share`` of the localizations, by mode."""
    n = locs.agg(F.count("*").alias("n"), F.count_distinct("frame").alias("frames"))
    by = {BY_WINDOWS: F.floor(F.col("n") / var), BY_COUNT: F.lit(float(var))}.get(mode, F.col("n") * float(var) / F.col("frames"))
    return n.select(F.floor(by * share).cast("long").alias("max_locs_per_segment"))


def coarsened(segments: DataFrame, n: int, total: int) -> DataFrame:
    """Segments joined by ``total // n`` at a time: coarse segment, number of segments, mean of centers, localizations."""
    return segments.groupBy(F.floor(F.col("segment") / (total // n)).cast("int").alias("segment")).agg(
        F.count("*").alias("n_segments"), F.avg("center_frame").alias("center_frame"), F.sum("n_locs").alias("n_locs")
    )


def ladder(total: int) -> list[int]:
    """Numbers of segments from coarse to fine: halves of ``total``, down to 3."""
    out = []
    while total >= 3:
        out.append(total)
        total //= 2
    return out[::-1]
