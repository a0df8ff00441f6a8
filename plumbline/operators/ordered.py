"""What depends on an order over a whole table, without one task that sees it all.

Rows are dealt by ranges of the order, ``size`` rows to a partition on average, sorted there and written. A second look at
the partitions (a row for each) says what lies before each of them: numbers, running sums, next values and chains of
pointers follow from the two. A table of ``size`` rows or fewer is one partition, and a longer one is more of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Rows of a partition, on average, until there are so many partitions.
SIZE, MOST = 1 << 17, 50_000
_PART, _PLACE = "__part", "__place"


def _parts(n_rows: int, size: int | None) -> int:
    return min(MOST, max(1, math.ceil(n_rows / (size or SIZE))))


def pieces(rows: DataFrame, order: list[str], size: int | None = None, n_rows: int | None = None) -> DataFrame:
    """The rows in sorted partitions that follow each other in the order. Names in ``order`` may end in " DESC"."""
    n = _parts(rows.count() if n_rows is None else n_rows, size)
    by = [F.desc(c[:-5]) if c.endswith(" DESC") else F.asc(c) for c in order]
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _placed(rows: DataFrame, order: list[str], size: int | None, n_rows: int | None = None) -> DataFrame:
    """Written, so that partitions and places stay as they are."""
    return cut(pieces(rows, order, size, n_rows).withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, F.monotonically_increasing_id()))


def _before(sums: DataFrame, *names: str) -> DataFrame:
    """Of a table with a row per partition, the sums of the partitions before."""
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(_PART, *(c for c in sums.columns if c not in (_PART, *names)), *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in names))


def numbered(rows: DataFrame, order: list[str], name: str = "k", size: int | None = None) -> DataFrame:
    """The rows with their numbers in the order, from 0 to n - 1; ties are broken as the rows happen to lie."""
    at = _placed(rows, order, size)
    before = _before(at.groupBy(_PART).agg(F.min(_PLACE).alias("__first"), F.count("*").alias("__n")), "__n")
    return at.join(F.broadcast(before), _PART).withColumn(name, F.col(_PLACE) - F.col("__first") + F.col("__n")).drop(_PART, _PLACE, "__first", "__n")  # a row per partition


def running(rows: DataFrame, order: list[str], sums: dict[str, str], size: int | None = None, n_rows: int | None = None) -> DataFrame:
    """The rows with running sums, their own row included: ``sums`` names the column of each."""
    at = _placed(rows, order, size, n_rows)
    whole = at.groupBy(_PART).agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    before = _before(whole, *(f"__{k}" for k in sums))
    here = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumns({k: F.sum(c).over(here) for k, c in sums.items()}).join(F.broadcast(before), _PART)  # a row per partition
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop(_PART, _PLACE, *(f"__{k}" for k in sums))


def _filled(batches):
    """Rows (value, point, id) from the largest value down: to each without a point the point last seen, if any."""
    last = -1
    for b in batches:
        point, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("point", "id"))
        seen = np.maximum.accumulate(np.where(point, np.arange(point.size), -1)) if point.size else np.zeros(0, np.int64)
        found = np.where(seen >= 0, at[np.maximum(seen, 0)], last) if point.size else at
        last = int(found[-1]) if point.size else last
        asks = ~point
        yield pa.RecordBatch.from_arrays([b.column("__part"), b.column("point"), b.column("id"), pa.array(np.where(asks, found, at))], names=["__part", "point", "id", "found"])


def next_points(points: DataFrame, asks: DataFrame, size: int | None = None, n_rows: int | None = None) -> DataFrame:
    """(id, found): for each row of ``asks`` (id, value) the id of the point (id, value) with the least value that is not
    under its own, the least id among equals; null if there is none. Values are whole numbers, ids 0 or more.
    """
    both = points.select("value", F.lit(True).alias("point"), "id").unionByName(asks.select("value", F.lit(False).alias("point"), "id"))
    # downwards, so that what is looked for has been seen before: points first, and of equal points the least id last
    at = pieces(both, ["value DESC", "point DESC", "id DESC"], size, n_rows).withColumn(_PART, F.spark_partition_id())
    found = cut(at.select(_PART, "point", "id").mapInArrow(_filled, "__part int, point boolean, id long, found long"))
    # ids of points ascend with their values, so the last point of a partition is its least
    ends = found.filter("point").groupBy(_PART).agg(F.min(F.struct("id")).alias("end"))
    parts = found.select(_PART).distinct().join(ends, _PART, "left")
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(_PART, F.last("end", ignorenulls=True).over(w)["id"].alias("carried"))
    out = found.filter("NOT point").join(F.broadcast(carried), _PART)  # a row per partition
    return out.select("id", F.when(F.col("found") >= 0, F.col("found")).otherwise(F.col("carried")).alias("found"))


def _leaps(batches):
    """Rows (id, next) of one partition from the largest id down: where a walk from each leaves the partition, and after
    how many steps. Pointers lead forward.
    """
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    ids, following = (rows.column(c).to_numpy() for c in ("id", "next"))
    where = {int(i): k for k, i in enumerate(ids)}
    exits, steps = following.copy(), np.ones(ids.size, np.int64)
    for k in range(ids.size):  # what a pointer leads to has been done before
        at = where.get(int(following[k]))
        if at is not None:
            exits[k], steps[k] = exits[at], steps[at] + 1
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(exits), pa.array(steps)], names=["id", "exit", "steps"])


def _walk(batches):
    """Rows (id, next, entry) of one partition: the ids that walks from its entries (rows with a number) meet in it."""
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    ids, following, entry = (rows.column(c).to_numpy() for c in ("id", "next", "entry"))
    where = {int(i): k for k, i in enumerate(ids)}
    met, number = [], []
    for start in np.flatnonzero(entry >= 0):
        k, n = int(start), int(entry[start])
        while k is not None:
            met.append(int(ids[k]))
            number.append(n)
            k, n = where.get(int(following[k])), n + 1
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(number, pa.int64())], names=["id", "number"])


def chain(pointers: DataFrame, first: int = 0, size: int | None = None, n_rows: int | None = None) -> DataFrame:
    """(id, number): the rows that one meets following ``next`` from ``first``, numbered from 0.

    ``pointers`` has id (0 or more, no two alike) and next, which leads to a larger id, or to none of the table (null).
    Rows are dealt in runs of ids. Within a partition walks are followed to where they leave it; from there the leaps are
    doubled: after the j-th round the rows known are those within 2**j leaps, and there are no more leaps than runs.
    """
    n_rows = pointers.count() if n_rows is None else n_rows
    n = _parts(n_rows, size)
    per = max(1, math.ceil(n_rows / n))
    dealt = lambda df: df.repartition(n, F.expr(f"id DIV {per}")).sortWithinPartitions(F.desc("id"))
    held = cut(pointers.select("id", F.coalesce("next", F.lit(-1)).alias("next")))
    leap = cut(dealt(held).mapInArrow(_leaps, "id long, exit long, steps long"))
    known = cut(leap.filter(F.col("id") == first).select("id", F.lit(0).cast("long").alias("number")))
    last = held.agg(F.max("id").alias("last")).first()["last"] or 0
    for _ in range(math.ceil(math.log2(1 + last // per))):
        ahead = known.join(leap, "id").select(F.col("exit").alias("id"), (F.col("number") + F.col("steps")).alias("number"))
        known = cut(known.unionByName(ahead.join(leap.select("id"), "id", "left_semi")).distinct())
        on = leap.select(F.col("id").alias("exit"), F.col("exit").alias("exit2"), F.col("steps").alias("steps2"))
        leap = cut(leap.join(on, "exit", "left").select("id", F.coalesce("exit2", "exit").alias("exit"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")))
    marked = held.join(known, "id", "left").select("id", "next", F.coalesce("number", F.lit(-1).cast("long")).alias("entry"))
    return dealt(marked).mapInArrow(_walk, "id long, number long")
