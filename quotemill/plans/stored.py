"""Queries over tables that are changed in parts: merged rollups, dropped days, labelled loads; and bars in order of arrival."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import bars
from quotemill.plans.streams import new_folder, tick_stream
from quotemill.plans.tables import TICKS, ticks
from quotemill.sources import tables
from quotemill.streaming import jobs, state

DAY = 86_400


def by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a day that the first tick of another day ends, with what the last 50 of them tell."""
    found = bars.held_history(bars.arrival_bars(ticks(spark, sf_dir), DAY, slot_rows=1 << 16), 50, 5)
    return _shown(found)


def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream's keyed state."""
    stream = state.stream_arrival_bars(tick_stream(spark, sf_dir), DAY, 50, 5, lateness="3650 days")
    return _shown(jobs.run_to_end(stream, new_folder(spark)))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("inst_id", F.unix_millis("bar_time").alias("bar_ms"), "open", "high", "low", "close", "volume", "tick_count", "completed_by", "bars_held", F.round("mean_close", 6).alias("mean_close"), "top_close", "bottom_close")


BY_ARRIVAL = f"""WITH {TICKS},
m AS (SELECT *, ms // 86400000 AS d, lag(ms // 86400000) OVER (PARTITION BY inst_id ORDER BY seq) AS was FROM ticks),
i AS (SELECT *, count(*) FILTER (was IS DISTINCT FROM d) OVER (PARTITION BY inst_id ORDER BY seq) AS bar FROM m),
b AS (SELECT inst_id, bar, min(d) * 86400000 AS bar_ms, arg_min(last, seq) AS open, max(last) AS high, min(last) AS low, arg_max(last, seq) AS close, arg_max(volume_24h, seq) AS volume, count(*) AS tick_count, min(seq) AS start FROM i GROUP BY 1, 2),
e AS (SELECT *, lead(start) OVER (PARTITION BY inst_id ORDER BY bar) AS completed_by FROM b)
SELECT inst_id, bar_ms, open, high, low, close, volume, tick_count, completed_by, least(bar, 50) AS bars_held, round(avg(close) OVER (PARTITION BY inst_id ORDER BY bar ROWS 4 PRECEDING), 6) AS mean_close,
       max(close) OVER (PARTITION BY inst_id ORDER BY bar ROWS 49 PRECEDING) AS top_close, min(close) OVER (PARTITION BY inst_id ORDER BY bar ROWS 49 PRECEDING) AS bottom_close
FROM e WHERE completed_by IS NOT NULL"""


def rollup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly states merged from three increments whose ticks interleave, the second one sent twice; and days made of them."""
    path, rows = new_folder(spark), ticks(spark, sf_dir)
    for batch in (0, 1, 1, 2):
        tables.merge_rollup(rows.where(F.col("seq") % 3 == batch), batch, path, "1 hour")
    hours = tables.read_states(spark, path)
    days = tables.coarser_states(hours, "1 day")
    both = [tables.finished(s).withColumn("level", F.lit(level)) for s, level in ((hours, "hour"), (days, "day"))]
    out = both[0].unionByName(both[1])
    return out.select("level", "inst_id", F.unix_millis("window_start").alias("window_ms"), "open", "high", "low", "close", F.round("avg_price", 6).alias("avg_price"), F.round("sd_price", 4).alias("sd_price"), "tick_count")


_LEVEL = """SELECT '{0}' AS level, inst_id, epoch_ms(date_trunc('{0}', ts)) AS window_ms, arg_min(last, (ts, seq)) AS open, max(last) AS high, min(last) AS low, arg_max(last, (ts, seq)) AS close,
       round(avg(last), 6) AS avg_price, round(stddev_pop(last), 4) AS sd_price, count(*) AS tick_count FROM ticks GROUP BY inst_id, date_trunc('{0}', ts)"""
ROLLUP_MERGED = f"WITH {TICKS} {_LEVEL.format('hour')} UNION ALL {_LEVEL.format('day')}"


def retention_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of days from which those outside the horizon have been removed, counted by day."""
    path = new_folder(spark)
    ticks(spark, sf_dir).withColumn("trade_date", F.to_date("ts")).write.partitionBy("trade_date").parquet(path)
    tables.drop_days(spark, path, date(2024, 1, 20))
    left = spark.read.schema("seq long, last double, trade_date date").parquet(path)
    return left.groupBy(F.date_format("trade_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.round(F.sum("last"), 4).alias("total"))


RETENTION_DROPPED = f"""WITH {TICKS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(seq) AS last_seq, round(sum(last), 4) AS total FROM ticks
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-23' GROUP BY 1"""


def loads_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelled loads, one of them sent twice."""
    path, rows = new_folder(spark), ticks(spark, sf_dir).select("inst_id", "seq", "last")
    write = tables.load_labelled(path, "ticks", max_rows=5000)
    for batch in (0, 1, 1, 2):
        write(rows.where(F.col("seq") % 3 == batch), batch)
    found = tables.read_loads(spark, path, "inst_id string, seq long, last double")
    return found.groupBy("label", "inst_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.round(F.sum("last"), 4).alias("total"))


LOADS_COMMITTED = f"WITH {TICKS} SELECT 'ticks-' || (seq % 3) AS label, inst_id, count(*) AS n, max(seq) AS last_seq, round(sum(last), 4) AS total FROM ticks GROUP BY 1, 2"

_ALL = {
    "bars_by_arrival": (by_arrival, BY_ARRIVAL),
    "stream_state_history": (state_history, BY_ARRIVAL),
    "rollup_merged": (rollup_merged, ROLLUP_MERGED),
    "retention_dropped": (retention_dropped, RETENTION_DROPPED),
    "loads_committed": (loads_committed, LOADS_COMMITTED),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items()}
