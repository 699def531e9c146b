"""Rolling metrics over bars, the market overview and the rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.functions import columns as C

LAGS, SUMS, RANGES = (1, 5, 15, 60), (5, 15, 60, 1440), (5, 15, 60)


def realtime_metrics(bars: DataFrame) -> DataFrame:
    """Lagged prices, change rates (percent), volumes, range volatilities, extremes and trends.

    One window specification, so one sort: all frames are computed in the same pass.
    """
    run = W.partitionBy("inst_id").orderBy("window_end")
    rows = lambda n: run.rowsBetween(1 - n, 0)
    lagged = bars.withColumns({f"close_lag_{n}": F.lag("close", n).over(run) for n in LAGS})
    lagged = lagged.withColumns({f"volume_{n}": F.sum("volume").over(rows(n)) for n in SUMS})
    lagged = lagged.withColumns({f"high_{n}": F.max("high").over(rows(n)) for n in RANGES})
    lagged = lagged.withColumns({f"low_{n}": F.min("low").over(rows(n)) for n in RANGES})
    lagged = lagged.withColumns({f"mean_{n}": F.avg("avg_price").over(rows(n)) for n in RANGES})
    close = F.col("close")
    out = {f"change_rate_{n}": C.ratio(close - F.col(f"close_lag_{n}"), F.col(f"close_lag_{n}"), percent=True) for n in LAGS}
    out |= {f"volatility_{n}": C.ratio(F.col(f"high_{n}") - F.col(f"low_{n}"), F.col(f"mean_{n}"), percent=True) for n in RANGES}
    out["volatility_1"] = C.ratio(F.col("high") - F.col("low"), F.col("avg_price"), percent=True)
    for n in (1, 5, 60):
        lag = F.col(f"close_lag_{n}")
        out[f"trend_{n}"] = F.when(close > lag, "UP").when(close < lag, "DOWN").otherwise("FLAT")
    return lagged.withColumns(out).drop(*[f"mean_{n}" for n in RANGES])


def market_overview(metrics: DataFrame, change: str = "change_rate_1", volatility: str = "volatility_1") -> DataFrame:
    """One row per time: symbols, volume, rising, falling and flat counts, extremes."""
    rate = F.col(change)
    return (
        metrics.groupBy("window_end")
        .agg(
            F.count_distinct("inst_id").alias("total_symbols"),
            F.count_if(F.col("tick_count") > 0).alias("active_symbols"),
            F.sum("volume").alias("total_volume"),
            F.count_if(rate > 0).alias("rising"),
            F.count_if(rate < 0).alias("falling"),
            F.count_if(rate == 0).alias("flat"),
            F.round(F.avg(volatility), 6).alias("avg_volatility"),
            F.max(volatility).alias("max_volatility"),
            F.min(volatility).alias("min_volatility"),
            F.round(F.avg(change), 6).alias("avg_change"),
            F.max(change).alias("max_gain"),
            F.min(change).alias("max_loss"),
        )
        .withColumn("rising_ratio", F.round(F.col("rising") / F.col("total_symbols"), 6))
    )


def rankings(metrics: DataFrame, top: int = 10) -> DataFrame:
    """Top instruments per time, kind (GAIN, LOSS, VOLUME, VOLATILITY) and time span."""
    cells = []
    for n in LAGS:
        cells += [("GAIN", n, f"change_rate_{n}", 1), ("LOSS", n, f"change_rate_{n}", -1), ("VOLATILITY", n, f"volatility_{n}", 1)]
    cells += [("VOLUME", n, f"volume_{n}", 1) for n in SUMS]
    kinds = F.array(*[F.struct(F.lit(k).alias("ranking_type"), F.lit(n).alias("bars"), F.col(c).cast("double").alias("metric_value"), F.lit(s).alias("side")) for k, n, c, s in cells])
    long = metrics.select("inst_id", "window_end", "volume", F.explode(kinds).alias("k")).select("inst_id", "window_end", "volume", "k.*")
    place = W.partitionBy("window_end", "ranking_type", "bars").orderBy((F.col("metric_value") * F.col("side")).desc_nulls_last(), "inst_id")
    return long.withColumn("rank_no", F.row_number().over(place)).where(F.col("rank_no") <= top).drop("side")
