"""Trading signals from breakout rows in sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.functions import columns as C

#: Windows of volatility history, and profit over stop distance by strategy.
HISTORY, REWARD, DEFAULT_REWARD = 100, {"AGGRESSIVE": 3.0, "CONSERVATIVE": 1.5}, 2.0


def signal_type() -> Column:
    loud = F.col("volume") > F.col("volume_threshold")
    up = F.col("change_percent") > F.col("price_threshold")
    down = F.col("change_percent") < -F.col("price_threshold")
    return F.when(up & loud, "BUY").when(down & loud, "SELL").otherwise("HOLD")


def target_and_stop() -> dict[str, Column]:
    reward = F.lit(DEFAULT_REWARD)
    for kind, value in REWARD.items():
        reward = F.when(F.col("strategy_type") == kind, value).otherwise(reward)
    stop = 2 * F.col("volatility")
    side = F.when(F.col("signal_type") == "BUY", 1).when(F.col("signal_type") == "SELL", -1).otherwise(0)
    price = F.col("price")
    return {"target_price": F.round(price + side * reward * stop, 6), "stop_loss": F.round(price - side * stop, 6)}


def confidence() -> Column:
    loud = F.when(F.col("volume") > F.col("volume_threshold"), 20).otherwise(0)
    return F.round(C.clamp(F.least(10.0 * F.col("signal_count"), F.lit(50.0)) + loud - 5 * F.col("volatility"), 0.0, 100.0), 2)


def risk_score() -> Column:
    quiet = F.when(F.col("volume") < F.col("volume_threshold"), 30).otherwise(0)
    return F.round(C.clamp(10 * F.col("volatility") + 5 * F.abs("change_percent") + quiet, 0.0, 100.0), 2)


def window_stats(rows: DataFrame, length: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Latest row, mean price, volume and count per instrument and sliding window; works on streams too."""
    order = F.struct("ts", "seq")
    return (
        rows.groupBy("inst_id", F.window("ts", length, slide).alias("w"))
        .agg(
            F.max_by("price", order).alias("price"),
            F.max_by("change_percent", order).alias("change_percent"),
            F.avg("price").alias("mean_price"),
            F.sum("volume").alias("volume"),
            F.count("*").alias("signal_count"),
        )
        .select("inst_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "price", "change_percent", "mean_price", "volume", "signal_count")
    )


def score(stats: DataFrame) -> DataFrame:
    """Signals from window statistics that have a strategy and a volatility."""
    typed = stats.withColumn("signal_type", signal_type())
    return typed.withColumns(target_and_stop() | {"confidence": confidence(), "risk_score": risk_score()}).withColumn(
        "signal_id", C.signal_id(F.col("inst_id"), F.unix_micros("window_end"))
    )


def with_history(stats: DataFrame, history: int = HISTORY) -> DataFrame:
    """Adds volatility: the population deviation of the price over the trailing windows."""
    run = W.partitionBy("inst_id").orderBy("window_end").rowsBetween(1 - history, 0)
    return stats.withColumn("volatility", F.round(F.coalesce(F.stddev_pop("price").over(run), F.lit(0.0)), 8))


def high_risk(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("risk_score") > F.col("risk_threshold"))
