"""The given tables as ticks, bars and lookups, in Spark and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the type is the instrument, the value the price, props.k the 24-hour volume."""
    last = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("inst_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("user_id"),
        last.alias("last"),
        (last * 0.99).alias("bid"),
        (last * 1.01).alias("ask"),
        (last * (1 + ((F.col("event_id") % 7) - 3) / 100.0)).alias("open_24h"),
        (last * 1.05).alias("high_24h"),
        (last * 0.95).alias("low_24h"),
        F.get_json_object("props", "$.k").cast("double").alias("volume_24h"),
    )


#: The same as a common table expression.
TICKS = """ticks AS (
  SELECT event_type AS inst_id, ts, event_id AS seq, user_id, value AS last, value * 0.99::DOUBLE AS bid, value * 1.01::DOUBLE AS ask,
         value * (1 + ((event_id % 7) - 3) / 100.0::DOUBLE) AS open_24h, value * 1.05::DOUBLE AS high_24h, value * 0.95::DOUBLE AS low_24h,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume_24h, epoch_us(ts) // 1000 AS ms
  FROM events)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily bars: the priority is the instrument, the total price the price."""
    orders = read(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    return (
        orders.groupBy(F.col("o_orderpriority").alias("inst_id"), F.date_trunc("day", "o_orderdate").cast("timestamp").alias("bar_time"))
        .agg(
            F.min_by("o_totalprice", at).alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", at).alias("close"),
            F.sum(F.col("o_custkey").cast("double")).alias("volume"),
        )
        .select("inst_id", "bar_time", "open", "high", "low", "close", "volume")
    )


BARS = """bars AS (
  SELECT o_orderpriority AS inst_id, date_trunc('day', o_orderdate) AS bar_time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(CAST(o_custkey AS DOUBLE)) AS volume
  FROM orders GROUP BY 1, 2)"""
