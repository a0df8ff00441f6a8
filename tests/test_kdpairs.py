"""Pair search over a k-d partition against brute force and against the join on cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import kdpairs as K
from plumbline.operators import pairs as P

SCHEMA = "loc_id long, x double, y double, z double, frame int"


def brute(rows, r):
    out = []
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if all(v is not None and v == v for p in (a, b) for v in p[1:4]) and sum((a[c] - b[c]) ** 2 for c in (1, 2, 3)) <= r * r:
                i, j = sorted((a[0], b[0]), key=lambda v: (v is None, v or 0))
                out.append((i, j, *(round(abs(a[c] - b[c]), 6) for c in (1, 2, 3))))
    return sorted(out, key=str)


def found(df):
    return sorted(((p.loc_i, p.loc_j, round(abs(p.dx0), 6), round(abs(p.dy0), 6), round(abs(p.dz0), 6)) for p in df.collect()), key=str)


@pytest.mark.parametrize("leaf_rows", [3, 20, 1000])
def test_no_pair_is_lost_across_splits(spark, leaf_rows):
    """Uniform, clustered, on a grid whose distances are the radius, all in one place, on a line, with nulls."""
    r = random.Random(leaf_rows)
    u = lambda s: round(r.uniform(-s, s), 2)
    clouds = {
        "uniform": [(k, u(50), u(50), u(50), 0) for k in range(150)],
        "clustered": [(r.choice((None, 1, 2, 3)), c + u(1), c * 2 + u(1), u(1), 0) for c in (0, 5, 500) for _ in range(40)],
        "grid": [(k, 10.0 * (k % 5), -10.0 * (k // 5 % 4), 1e6 + 10.0 * (k // 20), 0) for k in range(80)],
        "one place": [(k % 50, 7.0, 7.0, 7.0, 0) for k in range(60)],
        "line": [(k, float(k), 0.0, 0.0, 0) for k in range(100)],
        "odd": [(1, None, 0.0, 0.0, 0), (2, float("nan"), 0.0, 0.0, 0), (3, 0.0, 0.0, 0.0, 0), (4, -0.0, 0.0, 0.0, 0), (5, float("inf"), 0.0, 0.0, 0)],
        "none": [],
    }
    for name, rows in clouds.items():
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(K.within_radius_kd(df, 10.0, leaf_rows=leaf_rows)) == brute([p for p in rows if float("inf") not in p], 10.0), name


def test_carried_columns_go_with_their_rows(spark):
    r = random.Random(1)
    rows = [(k, r.uniform(0, 30), r.uniform(0, 30), 0.0, k % 7) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("note", F.concat(F.lit("n"), "loc_id"))
    of = lambda p: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in p.select("loc_i", "loc_j", "frame_i", "frame_j", "note_i", "note_j", "dx0", "dy0", "dz0").collect())
    assert of(K.within_radius_kd(df, 6.0, ("frame", "note"), leaf_rows=10)) == of(P.within_radius(df, 6.0, ("frame", "note")))


def test_a_cluster_is_spread_over_tasks(spark):
    """All rows within a tenth of the radius: many slots, each owning a bounded share, and every pair."""
    r = random.Random(2)
    rows = [(k, r.uniform(0, 1), r.uniform(0, 1), r.uniform(0, 1), 0) for k in range(400)]
    pairs = K.within_radius_kd(spark.createDataFrame(rows, SCHEMA), 10.0, leaf_rows=50).withColumn("task", F.spark_partition_id())
    by = [x["count"] for x in pairs.groupBy("task").count().collect()]
    assert sum(by) == 400 * 399 // 2 and len(by) >= 5 and max(by) < 0.5 * sum(by)


def test_leaves_are_even_and_visits_are_those_of_boxes():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(size=(3000, 3)), r.normal(size=(3000, 3)) * 0.01 + 5])
    tree = K.Tree.over(points, 32)
    row, leaf, home = tree.visits(points, 0.3)
    assert tree.n_leaves == 32 and np.array_equal(np.sort(row[home]), np.arange(6000))
    sizes = np.bincount(leaf[home], minlength=32)
    assert sizes.max() < 1.3 * 6000 / 32 and sizes.min() > 0.7 * 6000 / 32
    at = np.empty(6000, np.int64)
    at[row[home]] = leaf[home]
    met = set(zip(row.tolist(), leaf.tolist(), strict=True))
    for a in r.choice(6000, 60, replace=False):  # who is within the reach lives in a leaf that is visited
        for b in np.flatnonzero(((points - points[a]) ** 2).sum(1) <= 0.09):
            assert (int(a), int(at[b])) in met


def test_radius_must_be_positive(spark):
    with pytest.raises(ValueError):
        K.within_radius_kd(spark.createDataFrame([], SCHEMA), 0.0)
