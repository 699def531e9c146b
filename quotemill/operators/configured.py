"""Indicators as a lookup table configures them: with parameters of their own, and for the time in which they hold.

The different sets of parameters that the table names become nodes of one indicator graph when the plan is made, so
sets that share a part share its column; each bar then takes the sets of its own configurations. A log of
changes is compacted to intervals of validity, which a temporal equi-join by symbol and time slot finds for each bar.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.operators import formulas as f
from quotemill.operators import joins, presets
from quotemill.operators.indicators import Ind, close, compute

#: Different sets of parameters that one plan can hold; they are read when it is made.
MAX_SETS = 1000
#: Slots that a version is dealt to at most; longer and open ones are met by their symbol alone.
MAX_SLOTS = 64


@dataclass(frozen=True)
class Form:
    """What an indicator is made of: its defaults, and from parameters its value, further values and rules."""

    defaults: Mapping[str, float]
    build: Callable[..., tuple[Ind, dict[str, Ind], presets.Rules]]


def _average(mean: Callable[[Ind, float], Ind]):
    """Two means that cross; a single `period` is a mean that the price crosses."""

    def build(short_period, long_period, period):
        if period:
            line = mean(close, period)
            return line, {}, (f.crosses_up(close, line), f.crosses_down(close, line))
        a, b = mean(close, short_period), mean(close, long_period)
        return a, {"long": b}, (f.crosses_up(a, b), f.crosses_down(a, b))

    return Form({"short_period": 9, "long_period": 21, "period": 0}, build)


def _rsi(period, oversold, overbought):
    x = f.rsi(close, period)
    return x, {}, (f.crosses_up(x, float(oversold)), f.over(x, float(overbought)))


def _macd(short_period, long_period, signal_period):
    dif = f.macd(close, short_period, long_period)
    dea = f.ema(dif, signal_period)
    return dif, {"dif": dif, "dea": dea, "histogram": dif - dea}, (f.crosses_up(dif, dea), f.crosses_down(dif, dea))


def _bands(period, k):
    lower, upper = f.band(close, period, -k), f.band(close, period, k)
    return f.sma(close, period), {"lower": lower, "upper": upper}, (f.under(close, lower), f.over(close, upper))


def _kdj(period, low_limit, high_limit):
    k = f.stoch_k(period)
    d = f.sma(k, 3)
    j = k * 3.0 - d * 2.0
    return k, {"d": d, "j": j}, (f.crosses_up(j, float(low_limit)), f.crosses_down(j, float(high_limit)))


def _line(x: Callable[[float], Ind], enter: float, leave: float, period: float) -> Form:
    """A line that crosses a limit upwards and another downwards."""

    def build(period, enter, leave):
        line = x(period)
        return line, {}, (f.crosses_up(line, float(enter)), f.crosses_down(line, float(leave)))

    return Form({"period": period, "enter": enter, "leave": leave}, build)


def _channel(period):
    top, bottom = f.top(period), f.bottom(period)
    return (top + bottom) / 2.0, {"upper": top, "lower": bottom}, (f.crosses_up(close, top), f.crosses_down(close, bottom))


#: Indicators that take parameters. Names, lengths and limits are fixed values; other presets have none.
FORMS: dict[str, Form] = {
    "SMA": _average(f.sma),
    "EMA": _average(f.ema),
    "WMA": _average(f.wma),
    "ZLEMA": _average(f.zlema),
    "RSI": Form({"period": 14, "oversold": 30, "overbought": 70}, _rsi),
    "MACD": Form({"short_period": 12, "long_period": 26, "signal_period": 9}, _macd),
    "BOLLINGER_BANDS": Form({"period": 20, "k": 2}, _bands),
    "KDJ": Form({"period": 9, "low_limit": 20, "high_limit": 80}, _kdj),
    "WILLIAMS_R": _line(f.williams_r, -80.0, -20.0, 14),
    "CCI": _line(f.cci, -100.0, 100.0, 20),
    "ROC": _line(lambda n: f.roc(close, n), 0.0, 0.0, 12),
    "DONCHIAN_CHANNELS": Form({"period": 15}, _channel),
}


def configured(name: str, params: Mapping[str, str] | None = None) -> tuple[Ind, dict[str, Ind], presets.Rules]:
    """The value, further values and rules of an indicator with these parameters.

    A parameter that is missing, or isn't a positive number where a length is asked for, has its default; one
    that the indicator doesn't know is left aside. An indicator without a form has the price as its value.
    """
    name = presets.ALIASES.get(name.upper(), name.upper())
    if name not in FORMS:
        return close, {}, presets.preset(name)
    return FORMS[name].build(**dict(settled(name, params)))


def settled(name: str, params: Mapping[str, str] | None) -> tuple[tuple[str, float], ...]:
    """The parameters that a form really gets; equal for configurations that mean the same."""
    form, out = FORMS.get(name), {}
    for key, default in (form.defaults if form else {}).items():
        try:
            value = float((params or {})[key])
        except (KeyError, TypeError, ValueError):
            value = default
        if key.endswith("period"):
            value = int(value) if value == value and 1 <= value < 1e6 else default  # noqa: PLR0124
        out[key] = value if abs(value) < float("inf") else default
    return tuple(out.items())


CONFIG = ("config_id", "symbol", "indicator_type", "indicator_name", "params")


def _named(configs: DataFrame) -> DataFrame:
    """Adds `preset`: the indicator's name if it is known, else its type; unknown ones are left out."""
    known = [*presets.PRESETS, *presets.OPTIONAL]

    def full(c: str) -> Column:
        name = F.upper(F.col(c))
        for short, long in presets.ALIASES.items():
            name = F.when(name == short, long).otherwise(name)
        return F.when(name.isin(known), name)

    kind = full("indicator_type") if "indicator_type" in configs.columns else F.lit(None)
    return configs.withColumn("preset", F.coalesce(full("indicator_name"), kind)).where("preset is not null")


def validity(log: DataFrame, order: str = "changed_at") -> DataFrame:
    """A log of changes as intervals: CONFIG, valid_from, valid_to (null: still valid).

    A row of the log sets a configuration or, where it isn't enabled, removes it. Rows that repeat what already holds, as a
    refresh does, open no interval. Of rows of one configuration at one time, the last by content counts.
    """
    content = F.struct(F.coalesce("enabled", F.lit(False)).alias("enabled"), "symbol", "indicator_type", "indicator_name", F.array_sort(F.map_entries("params")).alias("params"))
    last = log.groupBy("config_id", order).agg(F.max(content).alias("c")).where(F.col(order).isNotNull())
    run = W.partitionBy("config_id").orderBy(order)
    same = F.col("c").eqNullSafe(F.lag("c").over(run)) | (~F.col("c.enabled") & ~F.coalesce(F.lag("c.enabled").over(run), F.lit(False)))
    changes = last.withColumn("__same", same).where("not __same")
    ends = changes.select("config_id", "c", F.col(order).alias("valid_from"), F.lead(order).over(run).alias("valid_to"))
    return ends.where("c.enabled").select("config_id", "c.symbol", "c.indicator_type", "c.indicator_name", F.map_from_entries("c.params").alias("params"), "valid_from", "valid_to")


def valid_at(rows: DataFrame, intervals: DataFrame, key: str = "inst_id", at: str = "bar_time", slot_seconds: int = 86_400) -> DataFrame:
    """Each row once for every interval of its symbol (or of `*`) that holds its time; adds config_id and `version`.

    intervals: config_id, symbol, version, valid_from (included), valid_to (not included, null: open). Intervals of
    up to MAX_SLOTS slots meet only the rows of their slots, longer ones the rows of their symbol.
    """
    slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / slot_seconds).cast("long")
    names = rows.columns
    seen = rows.select(F.struct(*names).alias("__row"), F.col(at).alias("__at"), F.explode(F.array_distinct(F.array(F.col(key), F.lit("*")))).alias("__who"))
    spans = intervals.where("valid_to is null or valid_from < valid_to").select(F.col("symbol").alias("__who"), "config_id", "version", "valid_from", "valid_to")
    far = slot(F.col("valid_to")) - slot(F.col("valid_from"))
    short = spans.where(far <= MAX_SLOTS).withColumn("__slot", F.explode(F.sequence(slot(F.col("valid_from")), slot(F.col("valid_to")))))
    long = spans.where((far > MAX_SLOTS) | F.col("valid_to").isNull())
    holds = (F.col("__at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    near = seen.withColumn("__slot", slot(F.col("__at"))).join(short, ["__who", "__slot"]).where(holds).drop("__slot")
    return near.unionByName(seen.join(long, "__who").where(holds)).select("__row.*", "config_id", "version")


RESULT = ("config_id", "preset", "indicator_value", "extra_values", "signal_type")


def configured_signals(bars: DataFrame, configs: DataFrame, intervals: bool = False, limit: int = MAX_SETS) -> DataFrame:
    """(inst_id, bar_time, close, RESULT): each bar once for every enabled configuration of its instrument or of `*`.

    configs: CONFIG (without indicator_type, the name alone counts) and `enabled`; or, with `intervals`, CONFIG, valid_from and valid_to: a bar then sees the
    configuration of its own time. Instruments that no configuration names are left out before anything is computed.
    Entry gives BUY, else exit SELL, else HOLD; an instrument's first bar has no row. More than `limit` different sets of
    parameters are an error.
    """
    live = _named(configs if intervals else configs.where("enabled"))
    sets = live.select("preset", F.array_sort(F.map_entries("params")).alias("params")).distinct().limit(limit + 1).collect()
    if len(sets) > limit:
        raise ValueError(f"more than {limit} different sets of parameters")
    fixed = [(r.preset, settled(r.preset, {e.key: e.value for e in r.params or ()})) for r in sets]
    number = {s: i for i, s in enumerate(dict.fromkeys(fixed))}
    parts = [FORMS[n].build(**dict(p)) if n in FORMS else configured(n) for n, p in number]
    wanted: dict[str, Ind] = {"__bar": Ind("bar_number")}
    for i, (value, more, (enter, leave)) in enumerate(parts):
        wanted |= {f"__v{i}": value, f"__in{i}": enter, f"__out{i}": leave} | {f"__{i}_{k}": x for k, x in more.items()}
    symbols = live.select("symbol").distinct()
    named = bars.join(symbols.withColumnRenamed("symbol", "inst_id"), "inst_id", "left_semi")
    any_bar = symbols.where("symbol = '*'").limit(1).count() > 0
    out = compute(bars if any_bar else named, wanted).where("__bar >= 2")

    def answer(i: int) -> Column:
        kind = F.when(F.col(f"__in{i}"), "BUY").when(F.col(f"__out{i}"), "SELL").otherwise("HOLD")
        extra = F.create_map(*[x for k in parts[i][1] for x in (F.lit(k), F.col(f"__{i}_{k}"))]).cast("map<string, double>")
        return F.struct(F.col(f"__v{i}").alias("indicator_value"), extra.alias("extra_values"), kind.alias("signal_type"))

    if not parts:
        return bars.where("false").select("inst_id", "bar_time", "close", *[F.lit(None).cast(t).alias(c) for c, t in zip(RESULT, ("string", "string", "double", "map<string, double>", "string"), strict=True)])
    rows = out.select("inst_id", "bar_time", "close", F.array(*[answer(i) for i in range(len(parts))]).alias("__all"))
    which = F.create_map(*[x for r, s in zip(sets, fixed, strict=True) for x in (F.to_json(F.struct(F.lit(r.preset).alias("p"), _literal(r.params))), F.lit(number[s]))])
    own = F.to_json(F.struct(F.col("preset").alias("p"), F.array_sort(F.map_entries("params")).alias("v")))
    placed = live.withColumn("version", F.struct("preset", F.element_at(which, own).alias("set")))
    if intervals:
        met = valid_at(rows, placed.select("config_id", "symbol", "version", "valid_from", "valid_to"))
    else:
        met = joins.fan_out(rows, placed.select("config_id", F.col("symbol").alias("inst_id"), "version", "enabled"), "inst_id")
    return met.withColumn("__one", F.get("__all", F.col("version.set"))).select("inst_id", "bar_time", "close", "config_id", "version.preset", "__one.*")


def _literal(params) -> Column:
    """The sorted entries of a row's parameters as a literal, null as null."""
    kind = "array<struct<key: string, value: string>>"
    if params is None:
        return F.lit(None).cast(kind).alias("v")
    return F.array(*[F.struct(F.lit(e.key).alias("key"), F.lit(e.value).cast("string").alias("value")) for e in params]).cast(kind).alias("v")
