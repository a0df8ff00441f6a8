"""Written tables between steps: lineage ends there, and they survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def scratch(spark: SparkSession) -> str:
    """The shared folder: the checkpoint folder that the cluster names.

    Without one, a local folder is made where the whole of Spark runs on this machine; elsewhere executors could not
    share it, and that is an error.
    """
    sc = spark.sparkContext
    conf = sc._jsc.sc().conf()
    if not conf.contains(CLEAN):  # else written tables would stay until someone deletes the folder
        conf.set(CLEAN, "true")
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there. The files go when no table refers to them any more."""
    scratch(df.sparkSession)
    return df.checkpoint()
