"""Stream forms of the operators: watermarks, windowed aggregates, an interval join and keyed state.

Windows and the join are the batch operators over a stream with a watermark. What compares rows across
batches (jumps, breakouts, presets) runs the batch operator over each batch and the few rows that the
batch before carried for each key.

Spark's watermark follows the latest time seen in any partition, so an idle partition doesn't hold it
back. Of several streams the slowest leads; `kept_awake` lets another stream's time count for one that is silent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quotemill.functions import columns as C
from quotemill.operators import bars, configured, monitor, patterns, presets, signals

#: How late a row may come, and the bars of a key that a stream of indicators remembers.
LATENESS, HISTORY_BARS = "5 seconds", 500


def with_event_time(messages: DataFrame, column: str = "value", lateness: str = LATENESS) -> DataFrame:
    """Adds event_time, read from the raw message (now, where there is none), with a watermark."""
    at = F.coalesce(F.timestamp_millis(C.epoch_in_text(F.col(column))), F.current_timestamp())
    return messages.withColumn("event_time", at).withWatermark("event_time", lateness)


def watermarked(ticks: DataFrame, lateness: str | None = LATENESS, monotonous: bool = False) -> DataFrame:
    """Ticks with a watermark on ts: bounded lateness, none for ordered input, or no watermark at all."""
    if monotonous:
        return ticks.withWatermark("ts", "0 seconds")
    return ticks if lateness is None else ticks.withWatermark("ts", lateness)


def stream_bars(ticks: DataFrame, every: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Bars of a stream; each comes out once, when the watermark has passed its end."""
    return bars.ohlc(watermarked(ticks, lateness), every)


def stream_monitor(flagged: DataFrame, every: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    return monitor.market_monitor(watermarked(flagged, lateness), every)


def stream_window_stats(rows: DataFrame, length: str = "15 minutes", slide: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    return signals.window_stats(watermarked(rows, lateness), length, slide)


def kept_awake(rows: DataFrame, column: str, clock: DataFrame, clock_column: str, idle_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """`rows` with a watermark on `column` that goes on while they are silent: by the clock's time, `idle_seconds` behind it.

    clock: another stream. Its rows come in as heartbeats, which bear nothing but a time: they move the watermark and are
    dropped right after it, so they reach no state and no result. A row that is more than the idle time and the lateness behind the
    clock is late.
    """
    beat = (F.col(clock_column).cast("timestamp") - F.expr(f"INTERVAL {int(idle_seconds)} SECONDS")).alias(column)
    beats = clock.where(F.col(clock_column).isNotNull()).select(beat, F.lit(True).alias("__beat"))
    both = rows.withColumn("__beat", F.lit(False)).unionByName(beats, allowMissingColumns=True)
    # a draw from 0 to 1, which no beat outdoes: the optimizer moves neither this filter nor later ones before the watermark, where they would take the beats away
    real = F.rand(0) >= F.when(F.col("__beat"), 2.0).otherwise(0.0)
    return both.withWatermark(column, lateness).where(real).drop("__beat")


def stream_pairs(spot: DataFrame, swap: DataFrame, within_seconds: int = 10, lateness: str = LATENESS, how: str = "inner", idle_seconds: int | None = None) -> DataFrame:
    """Spot and swap rows of a symbol within some seconds of each other, both ends included.

    spot: symbol, spot_ts and others; swap: symbol, swap_ts and others. Both watermarks and the time
    bound let Spark drop state that can't meet a partner any more; how = leftOuter also gives the spot rows that have none, when
    that is certain. With idle_seconds a silent side is kept awake by the other one.
    """
    if idle_seconds is None:
        a, b = spot.withWatermark("spot_ts", lateness), swap.withWatermark("swap_ts", lateness)
    else:
        a = kept_awake(spot, "spot_ts", swap, "swap_ts", idle_seconds, lateness)
        b = kept_awake(swap, "swap_ts", spot, "spot_ts", idle_seconds, lateness)
    a, b = a.alias("a"), b.withColumnRenamed("symbol", "__symbol").alias("b")
    span = F.expr(f"INTERVAL {int(within_seconds)} SECONDS")
    near = (F.col("b.swap_ts") >= F.col("a.spot_ts") - span) & (F.col("b.swap_ts") <= F.col("a.spot_ts") + span)
    return a.join(b, (F.col("a.symbol") == F.col("b.__symbol")) & near, how).drop("__symbol")


def stream_once(ticks: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Of rows with equal keys that come within the lateness of each other, only the first stays; state leaves with the watermark."""
    return watermarked(ticks, lateness).dropDuplicatesWithinWatermark(keys)


def carried_through(rows: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], every: str | None = None) -> StreamingQuery:
    """Start a stream whose batches hand rows on: step(batch, carried) gives the result's rows and those to carry.

    Both are tables in `folder`, one part per batch. A batch reads what the one before it carried and
    replaces its own parts, so that a repeated batch gives the same rows once. `carried` is None in the
    first batch. The step is a plan over DataFrames: sorts and windows in it may spill, and nothing is
    gathered in Python. Only the last two parts of `carried` are needed; older ones may be cleared at any time.
    Without `every`, the stream runs to its present end.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        carried = batch.sparkSession.read.parquet(f"{folder}/carried/batch_id={number - 1}") if number else None
        out, kept = step(batch, carried)
        kept.write.mode("overwrite").parquet(f"{folder}/carried/batch_id={number}")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={number}")
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def carried_rows(rows: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], schema: str) -> DataFrame:
    """Run `carried_through` to the stream's present end and read its table, which a stream without rows leaves empty."""
    fields = StructType.fromDDL(schema)
    rows.sparkSession.createDataFrame([], fields).write.mode("overwrite").parquet(f"{folder}/rows/batch_id=-1")
    carried_through(rows, folder, step).awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(f"{folder}/rows").select(*fields.names)


def stream_jumps(ticks: DataFrame, folder: str, jump: float = monitor.JUMP, null_resets: bool = False, nulls_last: bool = False) -> DataFrame:
    """(inst_id, ts, seq, last, is_anomaly): each price against the key's last one, across batches.

    Carried: the last price of each key. It comes before all rows of the next batch, late ones too. null_resets and
    nulls_last are those of monitor.flag_jumps.
    """

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.withColumn("__new", F.lit(True))
        if carried is not None:
            rows = rows.unionByName(carried.select("inst_id", first.alias("ts"), F.lit(-(1 << 63)).alias("seq"), "last", F.lit(False).alias("__new")))
        prices = rows if null_resets else rows.where("last is not null")
        ends = prices.groupBy("inst_id").agg(F.max_by("last", F.struct("__new", monitor.arrival(nulls_last))).alias("last"))
        return monitor.flag_jumps(rows, jump, null_resets, nulls_last=nulls_last).where("__new").drop("__new"), ends

    first = F.timestamp_micros(F.lit(-(1 << 63))) if nulls_last else F.lit(None).cast("timestamp")
    rows = ticks.select("inst_id", "ts", "seq", F.col("last").cast("double").alias("last"))
    return carried_rows(rows, folder, step, "inst_id string, ts timestamp, seq long, last double, is_anomaly boolean")


def stream_breakouts(ticks: DataFrame, folder: str, calm: float = patterns.CALM, jump: float = patterns.BREAK, within_seconds: int = patterns.WITHIN_SECONDS) -> DataFrame:
    """The breakout pattern of a stream: ticks have inst_id, ts, seq, last, change_percent.

    Carried: each key's rows of the last `within_seconds`, since a match is shorter. A late row takes
    its place in time among them; a match comes out with the batch that brings its breakout.
    """

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.withColumn("__new", F.lit(True))
        rows = rows if carried is None else rows.unionByName(carried.withColumn("__new", F.lit(False)))
        found = patterns.breakouts(rows, "change_percent", calm, jump, within_seconds, carry=("__new",))
        ends = rows.groupBy(F.col("inst_id").alias("__inst")).agg(F.max("ts").alias("__end"))
        recent = F.col("ts") > F.col("__end") - F.expr(f"INTERVAL {int(within_seconds)} SECONDS")
        kept = rows.join(ends, F.col("inst_id").eqNullSafe(F.col("__inst"))).where(recent).select(*batch.columns)
        return found.where("__new").drop("__new", "break_change"), kept

    rows = ticks.select("inst_id", "ts", "seq", F.col("last").cast("double").alias("last"), F.nanvl(F.col("change_percent").cast("double"), F.lit(None)).alias("change_percent"))
    schema = "inst_id string, calm_start timestamp, calm_end timestamp, calm_price double, break_ts timestamp, break_seq long, break_price double"
    return carried_rows(rows, folder, step, schema)


def stream_presets(bars_in: DataFrame, folder: str, names: list[str], history: int = HISTORY_BARS) -> DataFrame:
    """Preset signals of a stream of bars (inst_id, bar_time, open, high, low, close, volume), each bar once.

    Carried: the last `history` bars of each key, the most that an indicator sees before a new bar.
    Bars come in order of time; one that isn't later than the carried ones of its key is dropped.
    """

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows, since = batch, None
        if carried is not None:
            since = carried.groupBy(F.col("inst_id").alias("__inst")).agg(F.max("bar_time").alias("__since"))
            fresh = F.col("inst_id").eqNullSafe(F.col("__inst")) & (F.col("bar_time") <= F.col("__since"))
            rows = batch.join(since, fresh, "left_anti").unionByName(carried)
        out = presets.preset_signals(rows, names)
        if since is not None:
            out = out.join(since, F.col("inst_id").eqNullSafe(F.col("__inst")) & (F.col("bar_time") <= F.col("__since")), "left_anti")
        newest = W.partitionBy("inst_id").orderBy(F.desc("bar_time"))
        return out, rows.withColumn("__age", F.row_number().over(newest)).where(F.col("__age") <= history).drop("__age")

    rows = bars_in.select("inst_id", "bar_time", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return carried_rows(rows, folder, step, "inst_id string, bar_time timestamp, close double, preset string, signal_type string, strength double")


def stream_configured(rows: DataFrame, log: Callable[[SparkSession], DataFrame], folder: str, at: str = "ts") -> DataFrame:
    """Each row of a stream with every configuration that held at its own time; adds config_id, indicator_name and params.

    The log of changes is read anew for each batch, so a configuration that is set, changed or removed meanwhile counts from
    its own time on, for rows that come late too.
    """
    version = F.struct("indicator_name", "params")

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        intervals = configured.validity(log(batch.sparkSession)).withColumn("version", version)
        out = configured.valid_at(batch, intervals, "inst_id", at)
        return out.select(*batch.columns, "config_id", "version.*"), batch.limit(0)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return carried_rows(rows, folder, step, f"{fields}, config_id string, indicator_name string, params map<string, string>")


def run_to_end(rows: DataFrame, folder: str) -> DataFrame:
    """Write what a stream has now to a table, with a checkpoint beside it, and read the table."""
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def refreshing(lookup: Callable[[SparkSession], DataFrame], use: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the lookup table anew for each batch before joining it."""

    def each(batch: DataFrame, number: int) -> None:
        write(use(batch, lookup(batch.sparkSession)), number)

    return each
