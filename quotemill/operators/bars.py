"""OHLC bars from ticks, and coarser bars from finer ones.

Every aggregate is built in, so Spark pre-aggregates before the shuffle: one instrument with a third
of all ticks sends one row per bar and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.functions import columns as C


def ohlc(ticks: DataFrame, every: str = "1 minute", volume_mode: str = "last_24h", extra: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling bars of ticks (inst_id, ts, seq, last, volume_24h[, last_size]).

    First and last are by (ts, seq). Volume: `last_24h` is the last 24-hour figure seen; `trade` sums
    last_size and adds `amount`. The change rate is a fraction, 0 where the bar opened at 0 or less.
    """
    order = F.struct("ts", "seq")
    volume = {"last_24h": [F.max_by("volume_24h", order).alias("volume")], "trade": []}
    if volume_mode == "trade":
        volume["trade"] = [F.sum("last_size").alias("volume"), F.sum(F.col("last") * F.col("last_size")).alias("amount")]
    bars = ticks.groupBy("inst_id", *extra, F.window("ts", every).alias("w")).agg(
        F.min_by("last", order).alias("open"),
        F.max("last").alias("high"),
        F.min("last").alias("low"),
        F.max_by("last", order).alias("close"),
        *volume[volume_mode],
        F.avg("last").alias("avg_price"),
        F.count("*").alias("tick_count"),
    )
    change = F.col("close") - F.col("open")
    return bars.select(
        "inst_id", *extra, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        *[c for c in bars.columns if c not in ("inst_id", "w", *extra)],
        change.alias("price_change"), C.ratio(change, F.col("open")).alias("price_change_rate"),
    )


def rollup(bars: DataFrame, every: str) -> DataFrame:
    """Coarser bars from finer ones: open of the first, close of the last, extremes, sums."""
    coarse = bars.groupBy("inst_id", F.window("window_start", every).alias("w")).agg(
        F.min_by("open", "window_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "window_start").alias("close"),
        F.sum("volume").alias("volume"),
        (F.sum(F.col("avg_price") * F.col("tick_count")) / F.sum("tick_count")).alias("avg_price"),
        F.sum("tick_count").alias("tick_count"),
    )
    change = F.col("close") - F.col("open")
    return coarse.select(
        "inst_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "open", "high", "low", "close", "volume", "avg_price", "tick_count",
        change.alias("price_change"), C.ratio(change, F.col("open")).alias("price_change_rate"),
    )


def signal_bars(ticks: DataFrame, every: str = "1 minute") -> DataFrame:
    """Bars whose extremes and volume come from the ticker's 24-hour figures; stamped with their start."""
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy("inst_id", F.window("ts", every).alias("w"))
        .agg(
            F.min_by("last", order).alias("open"),
            F.max("high_24h").alias("high"),
            F.min("low_24h").alias("low"),
            F.max_by("last", order).alias("close"),
            F.sum("volume_24h").alias("volume"),
        )
        .select("inst_id", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume")
    )


def arrival_bars(ticks: DataFrame, every_seconds: int = 60, slot_rows: int = 1 << 20) -> DataFrame:
    """Bars as they close on arrival: a tick of another minute than the one before it ends a bar; seq is the order of arrival.

    ticks: inst_id, ts, seq, last, volume_24h. A late tick opens its minute again, as a bar of its own. The last bar of
    an instrument is still open and isn't given. completed_by is the seq of the tick that ended the bar. Rows without a time are left
    out. Rows are dealt by instrument and slot of arrival; a slot begins with what those before it left, one row per slot.
    """
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (every_seconds * 1_000_000)).cast("long")
    cell, run = ["__inst", "__slot"], W.partitionBy("__inst", "__slot").orderBy("seq")
    before = W.partitionBy("__inst").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    rows = ticks.where("ts is not null").select(F.struct("inst_id").alias("__inst"), F.floor(F.col("seq") / slot_rows).alias("__slot"), "seq", at.alias("at"), "last", "volume_24h")
    ends = rows.groupBy(*cell).agg(F.max_by("at", "seq").alias("end"))
    ends = ends.select(*cell, F.last("end").over(before).alias("came"))
    last = F.coalesce(F.lag("at").over(run), F.col("came"))
    started = rows.join(ends, cell).withColumn("start", F.when(last.isNull() | (last != F.col("at")), F.col("seq")))
    starts = started.groupBy(*cell).agg(F.max("start").alias("newest"))
    starts = starts.select(*cell, F.last("newest", ignorenulls=True).over(before).alias("open"))
    own = F.coalesce(F.last("start", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0)), F.col("open"))
    bars = started.join(starts, cell).withColumn("start", own).groupBy("__inst", "start", "at").agg(
        F.min_by("last", "seq").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "seq").alias("close"),
        F.max_by("volume_24h", "seq").alias("volume"), F.count("*").alias("tick_count"),
    )
    ended = F.lead("start").over(W.partitionBy("__inst").orderBy("start"))
    return bars.withColumn("completed_by", ended).where("completed_by is not null").select(
        "__inst.inst_id", F.timestamp_seconds(F.col("at") * every_seconds).alias("bar_time"), "open", "high", "low", "close", "volume", "tick_count", "completed_by"
    )


def held_history(bars: DataFrame, history: int = 500, length: int = 20, order: str = "completed_by") -> DataFrame:
    """Adds what the last `history` bars of an instrument tell: how many they are, the mean of the last `length` closes, the extremes."""
    run = W.partitionBy("inst_id").orderBy(order)
    rows = lambda n: run.rowsBetween(1 - n, 0)
    return bars.withColumns(
        {
            "bars_held": F.count("*").over(rows(history)),
            "mean_close": F.avg("close").over(rows(length)),
            "top_close": F.max("close").over(rows(history)),
            "bottom_close": F.min("close").over(rows(history)),
        }
    )
