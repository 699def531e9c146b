"""Report queries over ticks, signals and indicators. Times come out as epoch milliseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.operators.bars import ohlc
from quotemill.operators.clean import last_time, since
from quotemill.plans.tables import TICKS, ticks

ms = lambda c: F.unix_millis(c).alias(f"{c}_ms")


def latest(rows: DataFrame, key: str = "inst_id", *order: str) -> DataFrame:
    """The last row of each key, by (ts, seq); a pre-aggregated max_by, so no window gathers a busy key."""
    by = F.struct(*(order or ("ts", "seq")))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), by).alias("r"))
    return best.select(key, "r.*")


def spread_percent() -> Column:
    return F.round(F.try_divide(F.col("ask") - F.col("bid"), "last") * 100, 4)


def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(ticks(spark, sf_dir))
    return rows.select("inst_id", ms("ts"), "last", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "volume_24h", spread_percent().alias("spread_percent")).orderBy("inst_id")


_LATEST = "latest AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY ts DESC, seq DESC) = 1)"
LATEST_PRICES = f"""WITH {TICKS}, {_LATEST}
SELECT inst_id, ms AS ts_ms, last, round(bid, 6) AS bid, round(ask, 6) AS ask, volume_24h, round((ask - bid) / nullif(last, 0) * 100, 4) AS spread_percent FROM latest"""


def top_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(ticks(spark, sf_dir)).withColumn("turnover", F.round(F.col("last") * F.col("volume_24h"), 4))
    return rows.select("inst_id", "last", "volume_24h", "turnover").orderBy(F.desc("last"), "inst_id").limit(10)


TOP_TURNOVER = f"""WITH {TICKS}, {_LATEST}
SELECT inst_id, last, volume_24h, round(last * volume_24h, 4) AS turnover FROM latest ORDER BY last DESC, inst_id LIMIT 10"""


def day_range_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = since(ticks(spark, sf_dir), "ts", "24 HOURS").groupBy("inst_id").agg(
        F.max("last").alias("high"), F.min("last").alias("low"), F.avg("last").alias("mean"), F.count("*").alias("n")
    )
    spread = F.col("high") - F.col("low")
    return rows.select("inst_id", "high", "low", F.round("mean", 6).alias("mean"), F.round(spread, 6).alias("range"), F.round(F.try_divide(spread, "low") * 100, 4).alias("range_percent"), "n").orderBy(F.desc("range_percent"))


_AS_OF = "now AS (SELECT max(ts) AS t FROM ticks)"
DAY_RANGE_STATS = f"""WITH {TICKS}, {_AS_OF}
SELECT inst_id, max(last) AS high, min(last) AS low, round(avg(last), 6) AS mean, round(max(last) - min(last), 6) AS range,
       round((max(last) - min(last)) / nullif(min(last), 0) * 100, 4) AS range_percent, count(*) AS n
FROM ticks, now WHERE ts >= t - INTERVAL 24 HOUR GROUP BY inst_id"""


def hour_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = since(ticks(spark, sf_dir), "ts", "1 HOUR")
    return rows.select("inst_id", ms("ts"), "seq", "last").orderBy("inst_id", F.desc("ts_ms"))


HOUR_TREND = f"WITH {TICKS}, {_AS_OF} SELECT inst_id, ms AS ts_ms, seq, last FROM ticks, now WHERE ts >= t - INTERVAL 1 HOUR"


def spread_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(ticks(spark, sf_dir))
    return rows.select("inst_id", F.round(F.col("ask") - F.col("bid"), 6).alias("spread"), spread_percent().alias("spread_percent")).orderBy(F.desc("spread"))


SPREAD_ANALYSIS = f"""WITH {TICKS}, {_LATEST}
SELECT inst_id, round(ask - bid, 6) AS spread, round((ask - bid) / nullif(last, 0) * 100, 4) AS spread_percent FROM latest"""


def top_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(ticks(spark, sf_dir)).select("inst_id", "volume_24h", "last").orderBy(F.desc("volume_24h"), "inst_id").limit(10)


TOP_VOLUME = f"WITH {TICKS}, {_LATEST} SELECT inst_id, volume_24h, last FROM latest ORDER BY volume_24h DESC, inst_id LIMIT 10"


def minute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = since(ticks(spark, sf_dir), "ts", "24 HOURS").groupBy("inst_id", F.date_format("ts", "yyyy-MM-dd HH:mm:00").alias("minute")).agg(
        F.round(F.avg("last"), 6).alias("mean"), F.max("last").alias("high"), F.min("last").alias("low"), F.count("*").alias("n")
    )
    return rows.orderBy("inst_id", F.desc("minute"))


MINUTE_STATS = f"""WITH {TICKS}, {_AS_OF}
SELECT inst_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS minute, round(avg(last), 6) AS mean, max(last) AS high, min(last) AS low, count(*) AS n
FROM ticks, now WHERE ts >= t - INTERVAL 24 HOUR GROUP BY 1, 2"""


def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and span of the last hours, and seconds since the last row of the table."""
    rows = since(ticks(spark, sf_dir), "ts", "6 HOURS")
    return rows.groupBy("inst_id").agg(
        F.count("*").alias("n"),
        F.unix_millis(F.min("ts")).alias("first_ms"),
        F.unix_millis(F.max("ts")).alias("last_ms"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("span_seconds"),
    )


LIVENESS = f"""WITH {TICKS}, {_AS_OF}
SELECT inst_id, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS span_seconds
FROM ticks, now WHERE ts >= t - INTERVAL 6 HOUR GROUP BY 1"""


def change_since(spark: SparkSession, sf_dir: str, hours: int = 24) -> DataFrame:
    """The last price beside the last one at or before some hours earlier; instruments without one go."""
    rows = ticks(spark, sf_dir)
    order, before = F.struct("ts", "seq"), last_time(rows, "ts") - F.expr(f"INTERVAL {hours} HOURS")
    joined = rows.groupBy("inst_id").agg(F.max_by("last", order).alias("price_now"), F.max_by("last", F.when(F.col("ts") <= before, order)).alias("price_before"))
    change = F.col("price_now") - F.col("price_before")
    return joined.where("price_before is not null").select("inst_id", "price_now", "price_before", F.round(change, 6).alias("change"), F.round(F.try_divide(change, "price_before") * 100, 4).alias("change_percent")).orderBy(F.desc("change_percent"))


CHANGE_SINCE = f"""WITH {TICKS}, {_AS_OF}, {_LATEST},
early AS (SELECT inst_id, arg_max(last, (ts, seq)) AS price_before FROM ticks, now WHERE ts <= t - INTERVAL 24 HOUR GROUP BY 1)
SELECT inst_id, last AS price_now, price_before, round(last - price_before, 6) AS change, round((last - price_before) / nullif(price_before, 0) * 100, 4) AS change_percent
FROM latest JOIN early USING (inst_id)"""


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labelled figures from one pass over the table."""
    rows = ticks(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_distinct("inst_id").alias("instruments"),
        F.count_if(F.col("last").isNull() | (F.col("last") <= 0)).alias("bad"),
        F.count_if(F.col("volume_24h").isNull()).alias("empty"),
        F.timestamp_diff("HOUR", F.min("ts"), F.max("ts")).alias("hours"),
    )
    return rows.selectExpr(
        "stack(5, 'rows', total, 'instruments', instruments, 'bad prices', bad, 'empty volumes', empty, 'span hours', hours) as (figure, value)"
    )


DATA_QUALITY = f"""WITH {TICKS}
SELECT 'rows' AS figure, count(*) AS value FROM ticks UNION ALL SELECT 'instruments', count(DISTINCT inst_id) FROM ticks
UNION ALL SELECT 'bad prices', count(*) FROM ticks WHERE last IS NULL OR last <= 0 UNION ALL SELECT 'empty volumes', count(*) FROM ticks WHERE volume_24h IS NULL
UNION ALL SELECT 'span hours', CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 3600000000 AS BIGINT) FROM ticks"""


def instrument_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("inst_id").agg(
        F.count("*").alias("n"), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"),
        F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")).alias("span_minutes"),
    )


INSTRUMENT_STATS = f"""WITH {TICKS}
SELECT inst_id, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS BIGINT) AS span_minutes
FROM ticks GROUP BY 1"""


def dashboard_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per hour and instrument, for three instruments, and each one's share of the hour's volume."""
    rows = ticks(spark, sf_dir).where(F.col("inst_id").isin("click", "view", "purchase")).withColumn("hour", F.unix_millis(F.date_trunc("hour", "ts")))
    counted = rows.groupBy("hour", "inst_id").agg(F.count("*").alias("n"), F.sum("volume_24h").alias("volume"))
    return counted.withColumn("share", F.round(F.try_divide("volume", F.sum("volume").over(W.partitionBy("hour"))), 6))


DASHBOARD_RATE = f"""WITH {TICKS},
c AS (SELECT epoch_ms(date_trunc('hour', ts)) AS hour, inst_id, count(*) AS n, sum(volume_24h) AS volume FROM ticks WHERE inst_id IN ('click', 'view', 'purchase') GROUP BY 1, 2)
SELECT *, round(volume / nullif(sum(volume) OVER (PARTITION BY hour), 0), 6) AS share FROM c"""


def layer_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("inst_id", ms("ts"), "seq", "last").orderBy(F.desc("ts_ms"), F.desc("seq")).limit(10)


LAYER_HEAD = f"WITH {TICKS} SELECT inst_id, ms AS ts_ms, seq, last FROM ticks ORDER BY ts DESC, seq DESC LIMIT 10"

def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw, the detail and the bar layer, as (inst_id, ts, seq, last); a bar's time is its start, its price its close."""
    raw = ticks(spark, sf_dir)
    shape = lambda df, at, seq, last: df.select("inst_id", F.col(at).alias("ts"), seq.cast("bigint").alias("seq"), F.col(last).alias("last"))
    return {
        "ods": shape(raw, "ts", F.col("seq"), "last"),
        "dwd": shape(raw.where("last > 0 and bid > 0 and ask > 0"), "ts", F.col("seq"), "last"),
        "dws": shape(ohlc(raw, "1 hour"), "window_start", F.lit(0), "close"),
    }


def layer_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten rows of each layer."""
    heads = [
        rows.orderBy(F.desc("ts"), F.desc("seq"), "inst_id").limit(10).select(F.lit(layer).alias("layer"), "inst_id", ms("ts"), "seq", "last")
        for layer, rows in _layers(spark, sf_dir).items()
    ]
    return reduce(DataFrame.unionByName, heads)


_LAYERS = f"""{TICKS}, layers AS (
  SELECT 'ods' AS layer, inst_id, ts, seq, last FROM ticks UNION ALL
  SELECT 'dwd', inst_id, ts, seq, last FROM ticks WHERE last > 0 AND bid > 0 AND ask > 0 UNION ALL
  SELECT 'dws', inst_id, date_trunc('hour', ts) AS ts, 0 AS seq, arg_max(last, (ts, seq)) AS last FROM ticks GROUP BY inst_id, date_trunc('hour', ts))"""
LAYER_HEADS = f"""WITH {_LAYERS}
SELECT layer, inst_id, epoch_us(ts) // 1000 AS ts_ms, CAST(seq AS BIGINT) AS seq, last FROM layers QUALIFY row_number() OVER (PARTITION BY layer ORDER BY ts DESC, seq DESC, inst_id) <= 10"""


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and first and last time of each instrument in each layer."""
    counts = [
        rows.groupBy("inst_id").agg(F.count("*").alias("n"), F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms")).withColumn("layer", F.lit(layer))
        for layer, rows in _layers(spark, sf_dir).items()
    ]
    return reduce(DataFrame.unionByName, counts)


LAYER_COUNTS = f"WITH {_LAYERS} SELECT layer, inst_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM layers GROUP BY 1, 2"

QUERIES = {
    "bi_latest_prices": latest_prices,
    "bi_top_turnover": top_turnover,
    "bi_day_range_stats": day_range_stats,
    "bi_hour_trend": hour_trend,
    "bi_spread_analysis": spread_analysis,
    "bi_top_volume": top_volume,
    "bi_minute_stats": minute_stats,
    "bi_liveness": liveness,
    "bi_change_since": change_since,
    "bi_data_quality": data_quality,
    "bi_instrument_stats": instrument_stats,
    "bi_dashboard_rate": dashboard_rate,
    "bi_layer_head": layer_head,
    "bi_layer_heads": layer_heads,
    "bi_layer_counts": layer_counts,
}
ORACLE_SQL = {
    "bi_latest_prices": LATEST_PRICES,
    "bi_top_turnover": TOP_TURNOVER,
    "bi_day_range_stats": DAY_RANGE_STATS,
    "bi_hour_trend": HOUR_TREND,
    "bi_spread_analysis": SPREAD_ANALYSIS,
    "bi_top_volume": TOP_VOLUME,
    "bi_minute_stats": MINUTE_STATS,
    "bi_liveness": LIVENESS,
    "bi_change_since": CHANGE_SINCE,
    "bi_data_quality": DATA_QUALITY,
    "bi_instrument_stats": INSTRUMENT_STATS,
    "bi_dashboard_rate": DASHBOARD_RATE,
    "bi_layer_head": LAYER_HEAD,
    "bi_layer_heads": LAYER_HEADS,
    "bi_layer_counts": LAYER_COUNTS,
}
