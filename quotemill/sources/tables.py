"""Partitioned tables that change in parts: merged rollups, days that age out, loads that are committed once.

A partition is a folder `column=value`. Only the partitions that a change touches are written or removed; the files of the others
stay as they are. Folders are handled by the file system of the path, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A path in whatever store it names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self.path, self._new = path.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.store = self._new(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        """The folders in it."""
        if not self.store.exists(self._new(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self.store.listStatus(self._new(self.path)) if s.isDirectory())

    def remove(self, name: str) -> None:
        self.store.delete(self._new(f"{self.path}/{name}"), True)

    def has(self, name: str) -> bool:
        return self.store.exists(self._new(f"{self.path}/{name}"))

    def rename(self, old: str, new: str) -> bool:
        return self.store.rename(self._new(f"{self.path}/{old}"), self._new(f"{self.path}/{new}"))


# Rollups as partial states.

STATE = (
    "inst_id string, window_start timestamp, open double, open_at struct<ts: timestamp, seq: bigint>, high double, low double, close double, "
    "close_at struct<ts: timestamp, seq: bigint>, total double, squares double, n bigint, batch bigint, day date"
)


def partial_states(ticks: DataFrame, every: str) -> DataFrame:
    """(inst_id, window_start, first and last price with their place, extremes, sums) of ticks (inst_id, ts, seq, last)."""
    place, price = F.struct("ts", "seq"), F.col("last").cast("double")
    found = ticks.where("ts is not null and last is not null").groupBy("inst_id", F.window("ts", every)["start"].alias("window_start")).agg(
        F.min_by(price, place).alias("open"), F.min(place).alias("open_at"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, place).alias("close"), F.max(place).alias("close_at"), F.sum(price).alias("total"), F.sum(price * price).alias("squares"), F.count("*").alias("n"),
    )
    return found.withColumn("day", F.to_date("window_start"))


def merged_states(states: DataFrame, *more: Column) -> DataFrame:
    """States of the same instrument and window as one; more: further aggregates."""
    return states.groupBy("inst_id", "window_start", "day").agg(
        F.min_by("open", "open_at").alias("open"), F.min("open_at").alias("open_at"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "close_at").alias("close"), F.max("close_at").alias("close_at"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("n").alias("n"), *more,
    )


def coarser_states(states: DataFrame, every: str) -> DataFrame:
    """The states of longer windows, made of these, not of ticks."""
    start = F.window("window_start", every)["start"]
    return merged_states(states.withColumn("window_start", start).withColumn("day", F.to_date(start)))


def finished(states: DataFrame) -> DataFrame:
    """Bars with mean and standard deviation, from states."""
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    return states.select("inst_id", "window_start", "open", "high", "low", "close", mean.alias("avg_price"), spread.alias("sd_price"), F.col("n").alias("tick_count"))


def read_states(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame:
    """The stored states, of some days only where they are named; empty where nothing is stored."""
    if not any(n.startswith("day=") for n in Folder(spark, path).names()):
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE).parquet(path)
    return rows if days is None else rows.where(F.col("day").isin(days))


def merge_rollup(ticks: DataFrame, batch: int, path: str, every: str = "1 minute") -> None:
    """Merge a batch of ticks into the rollup at `path`, a table of states by day; for foreachBatch.

    Only the days that the batch touches are read and written. Each state knows the latest batch of its day, so a batch that is repeated
    after a failure is merged into those days that don't have it yet. Batches come in order of their numbers. A late tick changes
    the first or last price by its place in time, not by its coming.
    """
    spark = ticks.sparkSession
    own = partial_states(ticks, every).persist()
    try:
        days = [r.day for r in own.select("day").distinct().collect()]  # as many as the batch has days
        if not days:
            return
        stored = read_states(spark, path, days)
        done = stored.groupBy("day").agg(F.max("batch").alias("latest")).where(F.col("latest") >= batch).select("day")
        fresh = own.withColumn("batch", F.lit(batch).cast("bigint")).join(F.broadcast(done), "day", "left_anti")
        kept = stored.join(F.broadcast(done), "day", "left_anti")
        both = merged_states(kept.unionByName(fresh)).withColumn("batch", F.lit(batch).cast("bigint"))
        out = both.select("inst_id", "window_start", "open", "open_at", "high", "low", "close", "close_at", "total", "squares", "n", "batch", "day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    finally:
        own.unpersist()


# Days that age out.


def expired_days(names: list[str], as_of: date, days_back: int = 7, days_ahead: int = 3, column: str = "trade_date") -> list[str]:
    """Of the names of partitions, those outside the horizon; what isn't a day's partition stays."""
    first, last = as_of - timedelta(days_back), as_of + timedelta(days_ahead)
    out = []
    for name in names:
        key, _, value = name.partition("=")
        try:
            day = date.fromisoformat(unquote(value))
        except ValueError:
            continue
        if key == column and not first <= day <= last:
            out.append(name)
    return out


def drop_days(spark: SparkSession, path: str, as_of: date, days_back: int = 7, days_ahead: int = 3, column: str = "trade_date") -> list[str]:
    """Remove the day partitions outside the horizon, whose names are returned. No row is read and no file of another day is touched."""
    folder = Folder(spark, path)
    gone = expired_days(folder.names(), as_of, days_back, days_ahead, column)
    for name in gone:
        folder.remove(name)
    return gone


# Loads that are committed once.


def load_labelled(path: str, label: str = "load", max_rows: int = 1_000_000, max_bytes: int = 128 << 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that loads a batch in two phases: staged under its label, then renamed into the table.

    A label that is in the table is skipped. A load that died while it was staged left nothing in the table, and its repetition
    stages anew. Files hold at most `max_rows` rows, and about `max_bytes` of JSON text, so that no part of a load is unbounded.
    """

    def write(rows: DataFrame, batch: int) -> None:
        folder = Folder(rows.sparkSession, path)
        name = f"label={label}-{batch}"
        if folder.has(name):
            return
        rows = rows.persist()
        try:
            size = rows.select(F.avg(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 1
            most = max(1, min(max_rows, int(max_bytes // max(size, 1))))
            rows.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{path}/_staged/{name}")
        finally:
            rows.unpersist()
        if not folder.rename(f"_staged/{name}", name) and not folder.has(name):
            raise OSError(f"{name} could not be committed")

    return write


def read_loads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed loads; staged ones aren't seen."""
    return spark.read.schema(f"{schema}, label string").parquet(path)
