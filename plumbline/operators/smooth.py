"""Smoothing of per-segment drift. Tables are per segment (small); every row meets the neighbours its window names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _boxcar(table: DataFrame, width: int, mapped, columns: tuple[str, ...], offsets: list[int]) -> DataFrame:
    if width < 1:
        raise ValueError("the width must be 1 or more")
    n = table.agg((F.max("segment") + 1).alias("n"))
    asked = table.select("segment").crossJoin(F.broadcast(n)).withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))  # one row beside each
    asked = asked.select(F.col("segment").alias("at"), mapped(F.col("segment") + F.col("offset"), F.col("n")).cast("int").alias("segment"))
    return asked.join(table, "segment").groupBy("at").agg(*((F.sum(c) / width).alias(c) for c in columns)).withColumnRenamed("at", "segment")


def reflected(q: Column, n: Column) -> Column:
    """Indices mirrored at the ends, the end value twice: b a | a b c | c b."""
    m = F.pmod(q, 2 * n)
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m)


def boxcar_reflect(table: DataFrame, width: int, columns: tuple[str, ...] = ("dx", "dy", "dz")) -> DataFrame:
    """Moving average with mirrored ends; an even width looks one further ahead than back. Segments count from 0."""
    return _boxcar(table, width, reflected, columns, list(range(-((width - 1) // 2), width // 2 + 1)))


def boxcar_edge(table: DataFrame, width: int, columns: tuple[str, ...] = ("dx", "dy", "dz")) -> DataFrame:
    """Moving average whose ends repeat the end value; an even width is taken as the next odd one."""
    width = width if width % 2 else width + 1
    return _boxcar(table, width, lambda q, n: F.greatest(F.least(q, n - 1), F.lit(0)), columns, list(range(-(width // 2), width // 2 + 1)))
