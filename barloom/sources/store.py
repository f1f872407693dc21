"""Cutting the lineage of long plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, one of our own, which goes with the process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        own = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        top = "file://" + own
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return top


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder.

    A plan of many scans is worked out once, and what is built on it is planned from there.
    """
    folder(df.sparkSession)
    return df.checkpoint()
