"""Cutting lineage before loops that read a table many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is named a local one, which only a local master can use."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="fieldspark-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: a leaf that later plans need not analyse again, safe when executors are lost.

    What is a checkpoint already is given back as it is.
    """
    if getattr(df, "_is_cut", False):
        return df
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._is_cut = True
    return out
