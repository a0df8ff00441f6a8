"""What the jobs share: their config file, where localizations come from, and what they log."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import readers

log = logging.getLogger("plumbline.jobs")
#: The columns of a localization, with their types.
LOC = {"loc_id": "bigint", "x": "double", "y": "double", "z": "double", "frame": "int"}


def configured(kind, spark: SparkSession, path: str | None, given: dict):
    """Settings of a job: those of its config file (JSON, read by Spark, so that it may lie anywhere), then those given."""
    settings = {}
    if path:
        settings = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    known = {f.name for f in fields(kind)}
    if unknown := set(settings) - known:
        raise KeyError(f"{path}: no setting called {sorted(unknown)[0]!r}")
    return replace(kind(), **(settings | {k: v for k, v in given.items() if v is not None}))


def as_locs(table: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A table's rows as localizations: ``columns`` has an SQL expression for each column."""
    return table.select(*(F.expr(columns[c]).cast(kind).alias(c) for c, kind in LOC.items()), *(F.expr(columns[c]).alias(c) for c in keep))


def read_locs(spark: SparkSession, path: str, columns: dict[str, str] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Localizations from a Parquet table by expressions, or from what the library's readers know by its ending."""
    return as_locs(spark.read.parquet(path), columns, keep) if columns else readers.read(spark, path)


def logged(what: str, **values) -> None:
    log.info("%s: %s", what, ", ".join(f"{k} {v}" for k, v in values.items()))


def begin() -> float:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return time.monotonic()
