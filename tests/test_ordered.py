"""Order over whole tables in many partitions, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.operators import segment as S


def sequential(counts, least):
    """The rule of counts as it is told: frame by frame."""
    total, held, number, out, open_frames = sum(n for _, n in counts), 0, 0, {}, []
    for k, (frame, n) in enumerate(counts):
        held += n
        open_frames.append(frame)
        if held >= least and (total - held >= least or k == len(counts) - 1):
            out |= dict.fromkeys(open_frames, number)
            number, held, open_frames = number + 1, 0, []
    return out | dict.fromkeys(open_frames, -1)


@pytest.mark.parametrize("size, cases", [(4, ((30, 30), (3, 1))), (7, ((40, 10_000), (60, 60), (40, 1))), (1000, ((1, 5), (1, 1), (90, 60), (3, 400)))])
def test_segments_by_count_equal_the_sequential_rule(spark, size, cases):
    r = random.Random(size)
    for frames, least in cases:
        counts = sorted((f, r.choice((1, 2, 30, 500))) for f in r.sample(range(1000), frames))
        df = spark.createDataFrame(r.sample(counts, len(counts)), "frame int, n long")
        got = {x.frame: x.segment for x in S.closes(df, least, size).collect()}
        assert got == sequential(counts, least), (frames, least)
    assert S.closes(spark.createDataFrame([], "frame int, n long"), 3, size).count() == 0


@pytest.mark.parametrize("size", [10, 500])
def test_numbers_and_running_sums(spark, size):
    r = random.Random(2)
    rows = [(r.randrange(40), k, r.randrange(9)) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(3)
    got = sorted((x.k, x.a, x.b) for x in ordered.numbered(df, ["a", "b"], size=size).collect())
    assert got == [(k, a, b) for k, (a, b, _) in enumerate(sorted(rows))]
    down = {x.b: x.k for x in ordered.numbered(df, ["b DESC"], size=size).collect()}
    assert down == {k: 99 - k for k in range(100)}
    upto, want = 0, {}
    for _, b, v in sorted(rows):
        upto += v
        want[b] = upto
    assert {x.b: x.s for x in ordered.running(df, ["a", "b"], {"s": "v"}, size).collect()} == want


@pytest.mark.parametrize("size", [5, 19, 500])
def test_next_points_and_chains(spark, size):
    r = random.Random(4)
    values = sorted(r.randrange(300) for _ in range(60))
    asks = [(k, r.randrange(320)) for k in range(80)]
    got = {x.id: x.found for x in ordered.next_points(spark.createDataFrame(list(enumerate(values)), "id long, value long"), spark.createDataFrame(asks, "id long, value long"), size).collect()}
    assert got == {k: next((i for i, w in enumerate(values) if w >= v), None) for k, v in asks}
    following = [(k, k + r.choice((1, 1, 2, 5, 40)) if r.random() < 0.99 else None) for k in range(120)]
    at, n, want, to = 0, 0, {}, dict(following)
    while at is not None and at in to:
        want[at], at, n = n, to[at], n + 1
    assert {x.id: x.number for x in ordered.chain(spark.createDataFrame(following, "id long, next long"), 0, size).collect()} == want


def test_no_task_takes_the_whole_table(spark):
    """A table of many times ``size`` rows is many partitions, and none of them holds much more than its share."""
    df = ordered._placed(spark.range(20_000).select((F.col("id") % 977).alias("a"), "id"), ["a", "id"], 1000)
    most = df.groupBy("__part").count().agg(F.max("count"), F.count("*")).first()
    assert most[1] == 20 and most[0] < 3000
