"""Indicators, preset signals and trades over daily bars. Times come out as epoch milliseconds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import table_functions
from quotemill.operators import formulas as f
from quotemill.operators import presets, trades
from quotemill.operators.configured import configured_signals, validity
from quotemill.operators.indicators import Ind, close, compute, high, low, volume
from quotemill.plans.indicator_sql import _exceeds, indicator_tables, preset_rows
from quotemill.plans.tables import BARS, daily_bars, read

def _bar_ms() -> Column:
    return F.unix_millis("bar_time").alias("bar_ms")


WINDOWED = {
    "sma_20": f.sma(close, 20),
    "sd_20": f.sd(close, 20),
    "upper_band": f.band(close, 20, 2),
    "highest_15": f.highest(high, 15),
    "lowest_15": f.lowest(low, 15),
    "roc_12": f.roc(close, 12),
    "wma_9": f.wma(close, 9),
    "stoch_14": f.stoch_k(14),
    "vwap_14": f.vwap(14),
    "obv": f.obv(),
    "percentile_20": f.percentile(close, 20, 25.0),
    "cci_20": f.cci(20),
}


def windowed_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute(daily_bars(spark, sf_dir), WINDOWED)
    return out.select("inst_id", _bar_ms(), *[F.round(c, 4).alias(c) for c in WINDOWED])


def _rows(n: int) -> str:
    return f"(PARTITION BY inst_id ORDER BY bar_time ROWS {n - 1} PRECEDING)"


_T = "((high + low + close) / 3)"
WINDOWED_SQL = f"""WITH {BARS},
a AS (SELECT *, lag(close, 12) OVER (PARTITION BY inst_id ORDER BY bar_time) AS c12, lag(close) OVER (PARTITION BY inst_id ORDER BY bar_time) AS c1, {_T} AS tp,
      list(close) OVER {_rows(9)} AS l9, list(close) OVER {_rows(20)} AS l20, list({_T}) OVER {_rows(20)} AS t20, avg({_T}) OVER {_rows(20)} AS tm FROM bars)
SELECT inst_id, epoch_ms(bar_time) AS bar_ms, round(avg(close) OVER {_rows(20)}, 4) AS sma_20, round(stddev_pop(close) OVER {_rows(20)}, 4) AS sd_20,
  round(avg(close) OVER {_rows(20)} + 2 * stddev_pop(close) OVER {_rows(20)}, 4) AS upper_band, round(max(high) OVER {_rows(15)}, 4) AS highest_15, round(min(low) OVER {_rows(15)}, 4) AS lowest_15,
  round((close - coalesce(c12, close)) / coalesce(c12, close) * 100, 4) AS roc_12, round(list_sum(list_transform(l9, lambda x, i: x * i)) / (len(l9) * (len(l9) + 1) / 2), 4) AS wma_9,
  round(coalesce((close - min(low) OVER {_rows(14)}) / nullif(max(high) OVER {_rows(14)} - min(low) OVER {_rows(14)}, 0), 0) * 100, 4) AS stoch_14,
  round(sum(tp * volume) OVER {_rows(14)} / sum(volume) OVER {_rows(14)}, 4) AS vwap_14, round(sum(CASE WHEN close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0 END) OVER (PARTITION BY inst_id ORDER BY bar_time), 4) AS obv,
  round(list_sort(l20)[CAST(greatest(ceil(25.0 * len(l20) / 100), 1) AS INTEGER)], 4) AS percentile_20,
  round(coalesce((tp - tm) / nullif(list_avg(list_transform(t20, lambda x: abs(x - tm))) * 0.015::DOUBLE, 0), 0), 4) AS cci_20 FROM a"""

RECURSIVE = {"ema_12": f.ema(close, 12), "rsi_14": f.rsi(close, 14), "macd": f.macd(close), "kama": f.kama(close), "sar": f.parabolic(), "atr_14": f.atr(14), "adx_14": f.adx(14)}


def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute(daily_bars(spark, sf_dir), RECURSIVE)
    return out.select("inst_id", _bar_ms(), *[F.round(c, 4).alias(c) for c in RECURSIVE])


def exponential_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute(daily_bars(spark, sf_dir), {"ema_12": f.ema(close, 12)})
    return out.select("inst_id", _bar_ms(), F.round("ema_12", 4).alias("ema_12"))


EXPONENTIAL_SQL = f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) AS r FROM bars),
e AS (SELECT inst_id, bar_time, r, close AS v FROM n WHERE r = 1 UNION ALL SELECT n.inst_id, n.bar_time, n.r, v + 2.0::DOUBLE / 13 * (n.close - v) FROM e JOIN n ON n.inst_id = e.inst_id AND n.r = e.r + 1)
SELECT inst_id, epoch_ms(bar_time) AS bar_ms, round(v, 4) AS ema_12 FROM e"""


def _signals(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    out = presets.preset_signals(daily_bars(spark, sf_dir), presets.FAMILIES.get(family, presets.OPTIONAL))
    return out.where("signal_type <> 'HOLD'").select("inst_id", _bar_ms(), "preset", "signal_type", "strength")


def _signals_sql(family: str) -> str:
    rows = preset_rows(presets.FAMILIES.get(family, presets.OPTIONAL), BARS)
    return f"{rows} SELECT inst_id, epoch_ms(bar_time) AS bar_ms, preset, signal_type, 80.0::DOUBLE AS strength FROM signals WHERE signal_type <> 'HOLD'"


def _recursive_sql() -> str:
    tables, last = indicator_tables(RECURSIVE.values(), "bars")
    return f"WITH RECURSIVE {BARS}, {tables} SELECT inst_id, epoch_ms(bar_time) AS bar_ms, {', '.join(f'round({i.column}, 4) AS {n}' for n, i in RECURSIVE.items())} FROM {last}"


def _coverage_sql() -> str:
    rows = preset_rows({n: presets.preset(n) for n in [*presets.BANDS, *_CROSSES]}, BARS)
    return f"""{rows} SELECT preset, count(*) AS n, count(DISTINCT inst_id) AS instruments, epoch_ms(min(bar_time)) AS first_ms, epoch_ms(max(bar_time)) AS last_ms
FROM signals WHERE signal_type <> 'HOLD' GROUP BY preset"""


def _configured_sql() -> str:
    rows = preset_rows({n: presets.preset(n) for n in ("SMA", "BOLLINGER_BANDS", "SIZE_FACTOR", "GOLDEN_CROSS", "SEASONALITY")}, BARS)
    return f"""{rows}, configs AS (SELECT n_name AS config_id, (['*', '1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', '*'])[n_nationkey + 1] AS symbol,
  (['SMA', 'BOLLINGER_BANDS', 'SIZE_FACTOR', 'SMA', 'GOLDEN_CROSS', 'SEASONALITY'])[n_nationkey + 1] AS wanted FROM nation WHERE n_nationkey < 6 AND n_nationkey <> 4)
SELECT config_id, preset, inst_id, signal_type, count(*) AS n FROM signals JOIN configs ON wanted = preset AND (symbol = '*' OR symbol = inst_id) GROUP BY ALL"""


def _trades_sql(exits: trades.Exits, name: str = "GOLDEN_CROSS") -> str:
    """The open position is a row of a recursive query: entry, best price and levels reached, by the bar before."""
    enter, leave = presets.preset(name)
    strength = f.rsi(close)
    tables, last = indicator_tables([enter, leave, strength], "bars")
    gain, top = "((b.close - p.entry) / p.entry * 100)", "greatest(p.best, b.close)"
    rules = [f"WHEN p.level <= {i} AND {gain} >= {x} THEN 'level_{i + 1}'" for i, x in enumerate(exits.levels)]
    if exits.stops:
        rules.append(f"WHEN {gain} <= ({list(exits.stops)})[CAST(least(greatest(p.level - 1, 0), {len(exits.stops) - 1}) AS INTEGER) + 1] THEN 'stop'")
    elif exits.stop_loss is not None:
        rules.append(f"WHEN {gain} <= -{exits.stop_loss} THEN 'stop'")
    if exits.take_profit is not None:
        rules.append(f"WHEN {gain} >= {exits.take_profit} THEN 'take_profit'")
    if exits.trailing is not None:
        rules.append(f"WHEN b.close <= {top} * {1 - exits.trailing / 100!r}::DOUBLE THEN 'trailing_stop'")
    if exits.overbought is not None:
        rules.append(f"WHEN b.rsi > {exits.overbought} THEN 'overbought'")
    why = f"CASE WHEN p.opened IS NULL THEN NULL {' '.join(rules)} WHEN b.leave THEN 'signal' END"
    over = f"(why IS NOT NULL AND (why NOT LIKE 'level%' OR why = 'level_{len(exits.levels)}'))"
    return f"""WITH RECURSIVE {BARS}, {tables}, b AS MATERIALIZED (SELECT inst_id, r, bar_time, close, {enter.column} AS enter, {leave.column} AS leave, {strength.column} AS rsi FROM {last}),
p AS (
  SELECT inst_id, r, CASE WHEN enter THEN bar_time END AS opened, close AS entry, close AS best, 0 AS level, NULL::VARCHAR AS why, NULL::TIMESTAMP AS was, close AS paid, bar_time, close FROM b WHERE r = 1
  UNION ALL
  SELECT inst_id, r, CASE WHEN opened IS NULL THEN CASE WHEN enter THEN bar_time END WHEN {over} THEN NULL ELSE opened END, CASE WHEN opened IS NULL THEN close ELSE entry END,
         CASE WHEN opened IS NULL THEN close ELSE greatest(best, close) END, CASE WHEN opened IS NULL THEN 0 WHEN why LIKE 'level%' THEN CAST(substr(why, 7) AS INTEGER) ELSE level END, why, opened, entry, bar_time, close
  FROM (SELECT b.inst_id, b.r, b.bar_time, b.close, b.enter, p.opened, p.entry, p.best, p.level, {why} AS why FROM p JOIN b ON b.inst_id = p.inst_id AND b.r = p.r + 1)
),
ends AS (SELECT inst_id, max(r) AS r FROM b GROUP BY 1)
SELECT inst_id, epoch_ms(was) AS entry_time, paid AS entry_price, epoch_ms(bar_time) AS exit_time, close AS exit_price, why AS reason, round((close - paid) / paid * 100, 6) AS profit_percent FROM p WHERE why IS NOT NULL
UNION ALL SELECT inst_id, epoch_ms(opened), entry, NULL, NULL, NULL, NULL FROM p JOIN ends USING (inst_id, r) WHERE opened IS NOT NULL"""


_CROSSES = {"SMA": (9, 21), "GOLDEN_CROSS": (9, 26), "DEATH_CROSS": (26, 9), "TRIMA": (9, 21), "PRICE_PATTERN_RECOGNITION": (10, 20)}


def average_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = presets.preset_signals(daily_bars(spark, sf_dir), _CROSSES)
    return out.where("signal_type <> 'HOLD'").select("inst_id", _bar_ms(), "preset", "signal_type", "strength")


_PAIRS = " UNION ALL ".join(
    f"SELECT inst_id, bar_time, '{name}' AS preset, avg(close) OVER {_rows(a)} AS a, avg(close) OVER {_rows(b)} AS b FROM bars" for name, (a, b) in _CROSSES.items()
)
AVERAGE_CROSSINGS = f"""WITH {BARS}, p AS ({_PAIRS}), s AS (SELECT *, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 END AS side FROM p),
l AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY inst_id, preset ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s)
SELECT inst_id, epoch_ms(bar_time) AS bar_ms, preset, CASE WHEN side = 1 THEN 'BUY' ELSE 'SELL' END AS signal_type, 80.0::DOUBLE AS strength FROM l WHERE side = -was"""


def band_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = presets.preset_signals(daily_bars(spark, sf_dir), ["BOLLINGER_BANDS", "MAXIMUM_DRAWDOWN_CONTROL", "LOW_VOLATILITY_FACTOR"])
    return out.groupBy("inst_id", "preset").agg(*[F.count_if(F.col("signal_type") == k).alias(k.lower()) for k in ("BUY", "SELL", "HOLD")])


BAND_REVERSALS = f"""WITH {BARS}, i AS (SELECT *, avg(close) OVER {_rows(20)} AS m, stddev_pop(close) OVER {_rows(20)} AS s, stddev_pop(close) OVER {_rows(10)} AS s10, stddev_pop(close) OVER {_rows(30)} AS s30,
  row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) AS r FROM bars),
k AS (SELECT inst_id, 'BOLLINGER_BANDS' AS preset, CASE WHEN close < m - 2 * s THEN 1 WHEN close > m + 2 * s THEN -1 ELSE 0 END AS g FROM i WHERE r > 1
 UNION ALL SELECT inst_id, 'MAXIMUM_DRAWDOWN_CONTROL', CASE WHEN close > h60 * 0.95::DOUBLE THEN 1 WHEN close < h60 * 0.9::DOUBLE THEN -1 ELSE 0 END FROM (SELECT inst_id, close, max(close) OVER {_rows(60)} AS h60, r FROM i) WHERE r > 1
 UNION ALL SELECT inst_id, 'LOW_VOLATILITY_FACTOR', CASE WHEN s10 < s30 AND close > m THEN 1 WHEN s10 > s30 OR close < m THEN -1 ELSE 0 END FROM i WHERE r > 1)
SELECT inst_id, preset, count(*) FILTER (WHERE g = 1) AS buy, count(*) FILTER (WHERE g = -1) AS sell, count(*) FILTER (WHERE g = 0) AS hold FROM k GROUP BY 1, 2"""


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the presets that a configuration table names, per symbol or for all."""
    n = read(spark, sf_dir, "nation").where("n_nationkey < 6")
    names = F.array(*[F.lit(x) for x in ("MA", "BOLL", "SIZE_FACTOR", "SMA", "GOLDEN_CROSS", "SEASONALITY")])
    symbols = F.array(*[F.lit(x) for x in ("*", "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "*")])
    configs = n.select(F.col("n_name").alias("config_id"), F.get(symbols, F.col("n_nationkey")).alias("symbol"), F.get(names, F.col("n_nationkey")).alias("indicator_name"), (F.col("n_nationkey") != 4).alias("enabled"))
    out = configured_signals(daily_bars(spark, sf_dir), configs.withColumn("params", F.lit(None).cast("map<string, string>")))
    return out.groupBy("config_id", "preset", "inst_id", "signal_type").agg(F.count("*").alias("n"))


#: Indicator, symbol and parameters of the configurations below, by the number of a nation.
_FORMS = [
    ("SMA", "*", {"period": "5"}), ("SMA", "*", {"period": "30"}), ("SMA", "1-URGENT", {"short_period": "3", "long_period": "12"}), ("BOLL", "2-HIGH", {"period": "10", "k": "1.5"}),
    ("EMA", "*", {"period": "12", "unknown": "1"}), ("SMA", "3-MEDIUM", {"short_period": "x"}), ("DONCHIAN_CHANNELS", "*", {"period": "20"}), ("SMA", "*", {"period": "7"}),
]


def configured_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and signals of one indicator at several lengths, of others with parameters of their own, and none of a disabled one."""
    n = read(spark, sf_dir, "nation").where(f"n_nationkey < {len(_FORMS)}")
    pick = lambda values: F.get(F.array(*values), F.col("n_nationkey"))
    params = [F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) for _, _, p in _FORMS]
    names = {"indicator_name": [F.lit(f"{x[0]}_{i}") for i, x in enumerate(_FORMS)], "indicator_type": [F.lit(x[0]) for x in _FORMS], "symbol": [F.lit(x[1]) for x in _FORMS]}
    configs = n.select(F.col("n_name").alias("config_id"), *[pick(v).alias(c) for c, v in names.items()], pick(params).alias("params"), (F.col("n_nationkey") != 7).alias("enabled"))
    out = configured_signals(daily_bars(spark, sf_dir), configs)
    upper = F.round(F.col("extra_values")["upper"], 4).alias("upper")
    return out.select("config_id", "preset", "inst_id", _bar_ms(), F.round("indicator_value", 4).alias("value"), upper, "signal_type")


def _mean(n: int) -> str:
    return f"avg(close) OVER {_rows(n)}"


def _crossing(up: str, down: str) -> str:
    """BUY where the side `up` becomes 1 after -1, SELL where `down` becomes -1 after 1; of rows with k, inst_id and r."""
    before = "last_value({} IGNORE NULLS) OVER (PARTITION BY k, inst_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN {up} = 1 AND {before.format(up)} = -1 THEN 'BUY' WHEN {down} = -1 AND {before.format(down)} = 1 THEN 'SELL' ELSE 'HOLD' END"


_SIDE = f"CASE WHEN {_exceeds('a', 'b')} THEN 1 WHEN {_exceeds('b', 'a')} THEN -1 END"
CONFIGURED_PARAMETERS = f"""WITH RECURSIVE {BARS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) AS r FROM bars),
e AS (SELECT inst_id, r, close AS v FROM n WHERE r = 1 UNION ALL SELECT n.inst_id, n.r, v + 2.0::DOUBLE / 13 * (n.close - v) FROM e JOIN n ON n.inst_id = e.inst_id AND n.r = e.r + 1),
c AS (SELECT *, lag(hi) OVER (PARTITION BY inst_id ORDER BY r) AS top, lag(lo) OVER (PARTITION BY inst_id ORDER BY r) AS bottom FROM (SELECT *, max(high) OVER {_rows(20)} AS hi, min(low) OVER {_rows(20)} AS lo FROM n)),
lines AS (
  SELECT 0 AS k, inst_id, r, bar_time, close AS a, {_mean(5)} AS b, {_mean(5)} AS value FROM n
  UNION ALL SELECT 1, inst_id, r, bar_time, close, {_mean(30)}, {_mean(30)} FROM n
  UNION ALL SELECT 2, inst_id, r, bar_time, {_mean(3)}, {_mean(12)}, {_mean(3)} FROM n WHERE inst_id = '1-URGENT'
  UNION ALL SELECT 4, inst_id, n.r, bar_time, close, v, v FROM n JOIN e USING (inst_id, r)
  UNION ALL SELECT 5, inst_id, r, bar_time, {_mean(9)}, {_mean(21)}, {_mean(9)} FROM n WHERE inst_id = '3-MEDIUM'
),
sides AS (
  SELECT k, inst_id, r, bar_time, value, NULL::DOUBLE AS upper, {_SIDE} AS up, {_SIDE} AS down FROM lines
  UNION ALL SELECT 6, inst_id, r, bar_time, (top + bottom) / 2, top, CASE WHEN close > top THEN 1 WHEN close < top THEN -1 END, CASE WHEN close > bottom THEN 1 WHEN close < bottom THEN -1 END FROM c
),
crossed AS (SELECT *, {_crossing('up', 'down')} AS signal_type FROM sides),
band AS (SELECT *, {_mean(10)} AS m, stddev_pop(close) OVER {_rows(10)} AS s FROM n WHERE inst_id = '2-HIGH'),
found AS (
  SELECT k, inst_id, r, bar_time, value, upper, signal_type FROM crossed
  UNION ALL SELECT 3, inst_id, r, bar_time, m, m + 1.5 * s, CASE WHEN close < m - 1.5 * s THEN 'BUY' WHEN close > m + 1.5 * s THEN 'SELL' ELSE 'HOLD' END FROM band
)
SELECT n_name AS config_id, (['SMA', 'SMA', 'SMA', 'BOLLINGER_BANDS', 'EMA', 'SMA', 'DONCHIAN_CHANNELS'])[k + 1] AS preset, inst_id, epoch_ms(bar_time) AS bar_ms, round(value, 4) AS value, round(upper, 4) AS upper, signal_type
FROM found JOIN nation ON n_nationkey = k WHERE r > 1"""


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes: each nation sets, changes or removes its region's configuration; every row is sent again after a day."""
    n = read(spark, sf_dir, "nation")
    again = F.explode(F.array(F.lit(0), F.lit(1)))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("1992-01-01 00:00:00").cast("timestamp")) + F.col("n_nationkey") * 90 * 86400 + F.col("again") * 86400)
    period = (F.col("n_nationkey") % 3 * 4 + 3).cast("string")
    return n.withColumn("again", again).select(
        F.concat(F.lit("c"), "n_regionkey").alias("config_id"), at.alias("changed_at"), (F.col("n_nationkey") % 4 != 3).alias("enabled"),
        F.when(F.col("n_regionkey") % 2 == 0, "*").otherwise("1-URGENT").alias("symbol"), F.lit("MA").alias("indicator_type"), F.concat(F.lit("MA"), period).alias("indicator_name"),
        F.create_map(F.lit("period"), period).alias("params"),
    )


def configured_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by the configuration that held at each bar's own time."""
    out = configured_signals(daily_bars(spark, sf_dir), validity(config_log(spark, sf_dir)), intervals=True)
    return out.select("config_id", "inst_id", _bar_ms(), F.round("indicator_value", 4).alias("value"), "signal_type")


#: Versions as the log has them, repeated ones too.
VERSIONS = """versions AS (
  SELECT *, lead(changed_at) OVER (PARTITION BY config_id ORDER BY changed_at) AS until FROM (
    SELECT 'c' || n_regionkey AS config_id, TIMESTAMP '1992-01-01' + to_days(CAST(n_nationkey * 90 + again AS INTEGER)) AS changed_at, n_nationkey % 4 <> 3 AS enabled,
           CASE WHEN n_regionkey % 2 = 0 THEN '*' ELSE '1-URGENT' END AS symbol, n_nationkey % 3 * 4 + 3 AS period
    FROM nation, (SELECT unnest([0, 1]) AS again)))"""
CONFIGURED_AS_OF = f"""WITH {BARS}, {VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) AS r FROM bars),
lines AS ({' UNION ALL '.join(f'SELECT {k} AS k, inst_id, r, bar_time, close AS a, {_mean(k)} AS b FROM n' for k in (3, 7, 11))}),
sides AS (SELECT *, {_SIDE} AS side FROM lines),
crossed AS (SELECT *, {_crossing('side', 'side')} AS signal_type FROM sides)
SELECT config_id, inst_id, epoch_ms(bar_time) AS bar_ms, round(b, 4) AS value, signal_type FROM crossed
JOIN versions ON enabled AND k = period AND (symbol = '*' OR symbol = inst_id) AND bar_time >= changed_at AND (until IS NULL OR bar_time < until) WHERE r > 1"""


def sql_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by SQL alone, from the table function."""
    table_functions.register(spark)
    calls = {"SMA": "'SMA', map('period', '10')", "EMA": "'ema', map('period', '12')", "HIGHEST": "'HIGHEST'", "RSI": "'RSI', map('period', '1')"}
    parts = [f"SELECT '{n}' AS name, inst_id, unix_millis(bar_time) AS bar_ms, round(value, 4) AS value FROM indicator(TABLE({{bars}}), {c})" for n, c in calls.items()]
    return spark.sql(" UNION ALL ".join(parts), bars=daily_bars(spark, sf_dir))


SQL_INDICATORS = f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) AS r, close - lag(close) OVER (PARTITION BY inst_id ORDER BY bar_time) AS c FROM bars),
e AS (SELECT inst_id, bar_time, r, close AS v FROM n WHERE r = 1 UNION ALL SELECT n.inst_id, n.bar_time, n.r, v + 2.0::DOUBLE / 13 * (n.close - v) FROM e JOIN n ON n.inst_id = e.inst_id AND n.r = e.r + 1),
f AS (SELECT 'SMA' AS name, inst_id, bar_time, avg(close) OVER {_rows(10)} AS v FROM n UNION ALL SELECT 'EMA', inst_id, bar_time, v FROM e UNION ALL SELECT 'HIGHEST', inst_id, bar_time, max(high) OVER {_rows(15)} FROM n
  UNION ALL SELECT 'RSI', inst_id, bar_time, CASE WHEN c > 0 THEN 100 ELSE 0 END FROM n)
SELECT name, inst_id, epoch_ms(bar_time) AS bar_ms, round(v, 4) AS value FROM f"""


def _trades(spark: SparkSession, sf_dir: str, exits: trades.Exits, name: str = "GOLDEN_CROSS") -> DataFrame:
    enter, leave = presets.preset(name)
    out = compute(daily_bars(spark, sf_dir), {"entry": enter, "exit": leave, "rsi": f.rsi(close)})
    found = trades.trades(out, exits)
    return found.withColumns({c: F.unix_millis(c) for c in ("entry_time", "exit_time")})


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which presets have said anything, for how many instruments, and since when."""
    out = presets.preset_signals(daily_bars(spark, sf_dir), [*presets.BANDS, *_CROSSES]).where("signal_type <> 'HOLD'")
    return out.groupBy("preset").agg(F.count("*").alias("n"), F.count_distinct("inst_id").alias("instruments"), F.unix_millis(F.min("bar_time")).alias("first_ms"), F.unix_millis(F.max("bar_time")).alias("last_ms"))


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price channel and volume-weighted mean, 0 until 20 bars are there."""
    full = Ind("over", (Ind("bar_number"), 19.5))
    top, bottom = f.highest(high, 20), f.lowest(low, 20)
    wanted = {"upper": top, "lower": bottom, "middle": (top + bottom) / 2.0, "width": top - bottom, "position": (close - bottom) / (top - bottom) * 100.0, "vwma": f.vwma(20), "simple": f.sma(close, 20), "volume_sum": f.total(volume, 20)}
    out = compute(daily_bars(spark, sf_dir), {k: f.choose(full, v, 0.0) for k, v in wanted.items()})
    return out.select("inst_id", _bar_ms(), *[F.round(c, 4).alias(c) for c in wanted])


CHANNEL = f"""WITH {BARS}, i AS (SELECT *, max(high) OVER {_rows(20)} AS u, min(low) OVER {_rows(20)} AS l, avg(close) OVER {_rows(20)} AS m, sum(volume) OVER {_rows(20)} AS v, sum(close * volume) OVER {_rows(20)} AS pv,
  row_number() OVER (PARTITION BY inst_id ORDER BY bar_time) >= 20 AS ok FROM bars)
SELECT inst_id, epoch_ms(bar_time) AS bar_ms, {', '.join(f'CASE WHEN ok THEN round({e}, 4) ELSE 0 END AS {n}' for n, e in (("upper", "u"), ("lower", "l"), ("middle", "(u + l) / 2"), ("width", "u - l"), ("position", "coalesce((close - l) / nullif(u - l, 0), 0) * 100"), ("vwma", "pv / v"), ("simple", "m"), ("volume_sum", "v")))} FROM i"""

_ALL = {
    "indicators_windowed": (windowed_indicators, WINDOWED_SQL),
    "indicators_recursive": (recursive_indicators, _recursive_sql()),
    "indicator_ema": (exponential_average, EXPONENTIAL_SQL),
    "indicator_channel": (channel, CHANNEL),
    "preset_average_crossings": (average_crossings, AVERAGE_CROSSINGS),
    "preset_counts": (band_reversals, BAND_REVERSALS),
    "preset_configured": (configured, _configured_sql()),
    "configured_parameters": (configured_parameters, CONFIGURED_PARAMETERS),
    "configured_as_of": (configured_as_of, CONFIGURED_AS_OF),
    "sql_indicators": (sql_indicators, SQL_INDICATORS),
    "preset_coverage": (coverage, _coverage_sql()),
    "trades_stops": (partial(_trades, exits=trades.Exits()), _trades_sql(trades.Exits())),
    "trades_multi_level": (partial(_trades, exits=trades.MULTI_LEVEL), _trades_sql(trades.MULTI_LEVEL)),
    "trades_advanced": (partial(_trades, exits=trades.ADVANCED), _trades_sql(trades.ADVANCED)),
} | {f"presets_{k}": (partial(_signals, family=k), _signals_sql(k)) for k in (*presets.FAMILIES, "optional")}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}
