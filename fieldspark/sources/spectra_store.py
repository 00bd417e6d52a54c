"""Stored Fourier coefficients: Parquet by station, run and level, with the recipe they were made by."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = (None, "parquet", "csv")


def recipe_hash(recipe: dict) -> str:
    # a letter first: as a partition's value it must never look like a number
    return "r" + hashlib.sha256(json.dumps(recipe, sort_keys=True, default=str).encode()).hexdigest()[:16]


def save_coefficients(fcs: DataFrame, path: str, recipe: dict, kind: str | None = "parquet") -> None:
    """Partitioned so that readers prune by station, run and level; sorted by harmonic so that they skip row groups."""
    if kind is None:
        return
    if kind not in KINDS:
        raise ValueError("coefficients are stored as parquet or csv")
    marked = fcs.withColumn("recipe", F.lit(recipe_hash(recipe)))
    by = [c for c in ("recipe", "station", "run", "level") if c in marked.columns]
    if kind == "csv":
        pairs = sorted(c[:-3] for c in fcs.columns if c.endswith("_re"))
        signed = lambda c: F.when(c.startswith("-"), c).otherwise(F.concat(F.lit("+"), c))
        text = [F.concat(F.lit("("), F.col(f"{c}_re").cast("string"), signed(F.col(f"{c}_im").cast("string")), F.lit("j)")).alias(c) for c in pairs]
        marked.select(*[c for c in fcs.columns if not c.endswith(("_re", "_im"))], *text).write.mode("overwrite").csv(path, header=True)
        return
    # only the partitions that are written are replaced: other recipes, stations, runs and levels stay
    marked.repartition(*by).sortWithinPartitions(*by, "k").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def stored_runs(spark: SparkSession, path: str, recipe: dict, need: DataFrame) -> DataFrame:
    """``need(station[, run], level)`` to (station[, run], fc): whether all the levels a run needs are stored under the recipe.

    All or nothing for a run, as deeper levels come from the ones above.  A store that is not there holds nothing.
    """
    keys = [c for c in need.columns if c != "level"]
    if not exists(spark, path):
        return need.select(*keys).distinct().withColumn("fc", F.lit(False))
    have = spark.read.parquet(path).where(F.col("recipe") == recipe_hash(recipe))
    have = have.select(*[F.col(k).cast(need.schema[k].dataType).alias(k) for k in (*keys, "level")]).distinct().withColumn("_there", F.lit(True))
    return need.join(have, [*keys, "level"], "left").groupBy(*keys).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("fc"))


def load_coefficients(spark: SparkSession, path: str, recipe: dict | None = None, n0_from: int | None = None, n0_to: int | None = None, channels: Sequence[str] | None = None) -> DataFrame:
    """The coefficients of a recipe, clipped to window starts in [n0_from, n0_to]; filters and columns reach the scan."""
    df = spark.read.parquet(path)
    if recipe is not None:
        df = df.where(F.col("recipe") == recipe_hash(recipe))
    if n0_from is not None:
        df = df.where(F.col("n0") >= n0_from)
    if n0_to is not None:
        df = df.where(F.col("n0") <= n0_to)
    if channels is not None:
        df = df.select(*[c for c in df.columns if not c.endswith(("_re", "_im")) or c[:-3] in channels])
    return df.drop("recipe")


def read_coefficient_csv(spark: SparkSession, path: str, channels: Sequence[str]) -> DataFrame:
    """Coefficients written as (a+bj) text."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    part = lambda c, i: F.expr(f"try_cast(regexp_extract(`{c}`, r'^\\(?({number})({number})j\\)?$', {i}) as double)")
    for c in channels:
        df = df.withColumns({f"{c}_re": part(c, 1), f"{c}_im": part(c, 2)})
    return df.drop(*channels)


def has_coefficients(stored: DataFrame, recipe: dict, levels: int) -> DataFrame:
    """(station, run, fc): whether a run has at least ``levels`` levels under the recipe."""
    ok = F.countDistinct(F.when(F.col("recipe") == recipe_hash(recipe), F.col("level"))) >= levels
    return stored.groupBy("station", "run").agg(ok.alias("fc"))
