"""Regular multichannel series from business tables, and run tables from intervals.

``daily_series`` reads the line items as five channels with one sample a day: the
line status is the station (O local, F remote).  All sums are over integers, so any
engine finds the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("hx", "hy", "hz", "ex", "ey")
DAY_ZERO = "1995-01-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, n, hx, hy, hz, ex, ey): quantity, discount, count, price (thousands) and tax per day."""
    items = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    day = F.datediff(F.to_date("l_shipdate"), F.lit(DAY_ZERO).cast("date")).cast("long")
    daily = items.where("l_shipdate is not null").groupBy(F.col("l_linestatus").alias("station"), day.alias("n")).agg(
        (cents("l_quantity") / 100.0).alias("hx"), (cents("l_discount") / 100.0).alias("hy"), F.count("*").cast("double").alias("hz"),
        (cents("l_extendedprice") / 100000.0).alias("ex"), (cents("l_tax") / 100.0).alias("ey"),
    )
    return daily


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (station, channel, n, v): events per hour; station is the parity of the user, channel the event type."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))) / 3_600_000_000).cast("long")
    return e.groupBy((F.col("user_id") % 2).cast("string").alias("station"), F.col("event_type").alias("channel"), hour.alias("n")).agg(F.count("*").cast("double").alias("v"))


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from orders: station = nation, run = customer, interval = first to last order day, one run per customer."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("string").alias("station"), F.col("c_custkey").cast("string").alias("run"), "start", "end")


def channel_rows(runs: DataFrame, channels: tuple[str, ...] = CHANNELS, survey: str = "orders") -> DataFrame:
    """A channel summary: one row per run and channel."""
    each = F.explode(F.array(*[F.lit(c) for c in channels])).alias("component")
    return runs.select(F.lit(survey).alias("survey"), "station", "run", each, "start", "end", F.lit(1 / 86400.0).alias("sample_rate"))
