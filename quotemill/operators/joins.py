"""Joins over time: interval join, as-of lookup, enrichment and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The interval in ms, the rate that is an opportunity, the fee per side.
INTERVAL_MS, MIN_RATE, FEE = 10_000, 0.005, 0.001
#: Lookup tables are broadcast up to this many rows; beyond it, they are shuffled.
MAX_LOOKUP_ROWS = 100_000


def small(lookup: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """The table with a broadcast hint if its row count, read here, is within the limit."""
    return F.broadcast(lookup) if lookup.limit(limit + 1).count() <= limit else lookup


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ms: str, right_ms: str, within_ms: int = INTERVAL_MS) -> DataFrame:
    """All pairs of one key whose times differ by at most `within_ms`, both ends included.

    Time is cut into slots of the interval's width: the left side looks into its own slot and the
    two beside it, so the join is an equality on key and slot and a busy key is spread over time.
    """
    width = max(1, within_ms)
    slots = F.explode(F.array(*[(F.floor(F.col(left_ms) / width) + d).cast("long") for d in (-1, 0, 1)]))
    a = left.withColumn("__slot", slots)
    b = right.withColumn("__slot", F.floor(F.col(right_ms) / width).cast("long")).withColumnRenamed(key, "__key")
    met = (a[key] == b["__key"]) & (a["__slot"] == b["__slot"])
    return a.join(b, met & F.col(right_ms).between(F.col(left_ms) - within_ms, F.col(left_ms) + within_ms)).drop(a["__slot"]).drop(b["__slot"]).drop("__key")


def arbitrage(pairs: DataFrame, spot: str = "spot_price", future: str = "future_price", min_rate: float = MIN_RATE, fee: float = FEE) -> DataFrame:
    """Spread, rate (percent), direction and profit of each pair whose rate is strictly beyond `min_rate`.

    Pairs without two positive prices go.
    """
    s, f = F.col(spot).cast("double"), F.col(future).cast("double")
    rate = F.round(F.try_divide(f - s, s), 6)
    found = pairs.where((s > 0) & (f > 0)).withColumn("spread", F.round(f - s, 8)).withColumn("rate", rate).where(F.abs("rate") > min_rate)
    return found.select(
        "*",
        F.round(F.col("rate") * 100, 4).alias("spread_rate"),
        F.when(F.col("spread") > 0, "LONG_SPOT_SHORT_FUTURE").otherwise("SHORT_SPOT_LONG_FUTURE").alias("direction"),
        F.round(F.abs("spread") - 2 * fee * s, 6).alias("profit_estimate"),
    ).drop("rate")


def allow_listed(rows: DataFrame, symbols: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose key is in the list; a semi join."""
    return rows.join(small(symbols.select(key).distinct()), key, "left_semi")


#: The trading strategy of a symbol that has none of its own.
DEFAULT_STRATEGY = {"risk_threshold": 50.0, "volume_threshold": 1_000_000.0, "price_threshold": 2.0, "strategy_type": "MODERATE"}


def with_strategy(rows: DataFrame, strategies: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds the symbol's strategy columns, or the defaults."""
    joined = rows.join(small(strategies.select(key, *DEFAULT_STRATEGY)), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_STRATEGY.items()})


#: Configs for all symbols that are broadcast; more of them are dealt into parts.
MAX_STARRED, STARRED_PARTS = 10_000, 64


def fan_out(rows: DataFrame, configs: DataFrame, key: str = "symbol") -> DataFrame:
    """Each row once for every enabled config of its symbol or of `*`.

    The `*` configs and the named ones are two equalities, not one comparison of all with all.
    """
    live = configs.where("enabled")
    keep = [c for c in live.columns if c not in (key, "enabled")]
    named = rows.join(small(live.where(F.col(key) != "*").select(key, *keep)), key)
    every = live.where(F.col(key) == "*").select(*keep)
    spread = 1 if every.limit(MAX_STARRED + 1).count() <= MAX_STARRED else STARRED_PARTS
    part = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__part")  # many configs are dealt to several tasks and met by a copy of the row in each
    configs_of = F.pmod(F.xxhash64(*keep), F.lit(spread)).cast("int").alias("__part")
    left, right = rows.select(F.struct(*rows.columns).alias("__row"), part), every.select(F.struct(*keep).alias("__c"), configs_of)
    starred = left.join(F.broadcast(right) if spread == 1 else right, "__part").select("__row.*", "__c.*")
    return named.select(*rows.columns, *keep).unionByName(starred)


def as_of_price(ticks: DataFrame, at: Column, name: str = "price") -> DataFrame:
    """(inst_id, price, price_ts): the last price at or before `at`, per instrument."""
    before = ticks.where(F.col("ts") <= at)
    order = F.struct("ts", "seq")
    return before.groupBy("inst_id").agg(F.max_by("last", order).alias(name), F.max("ts").alias(f"{name}_ts"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], slot_seconds: int = 86_400) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides are dealt by key and time slot; a slot begins with what the slots before it left, which
    is found from one row per slot. So a busy key is spread over tasks.
    """
    from pyspark.sql import Window as W

    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (slot_seconds * 1_000_000)).cast("long")
    value = F.struct(F.col(right_ts).alias("t"), *values)
    facts = right.where(F.col(right_ts).isNotNull()).select(F.col(key).alias("k"), slot(right_ts).alias("slot"), F.col(right_ts).alias("t"), value.alias("v"))
    asks = left.select(F.col(key).alias("k"), slot(left_ts).alias("slot"), F.col(left_ts).alias("t"), F.struct(*left.columns).alias("row"))
    ends = facts.groupBy("k", "slot").agg(F.max_by("v", "t").alias("v"))
    wanted = asks.select("k", "slot").distinct().join(ends.select("k", "slot", "v"), ["k", "slot"], "full")
    before = W.partitionBy("k").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = wanted.select("k", "slot", F.last("v", ignorenulls=True).over(before).alias("v")).where("v is not null")
    lined = (
        asks.select("k", "slot", "t", F.lit(2).alias("o"), F.lit(None).cast(facts.schema["v"].dataType).alias("v"), "row")
        .unionByName(facts.select("k", "slot", "t", F.lit(1).alias("o"), "v"), allowMissingColumns=True)
        .unionByName(carried.select("k", "slot", F.lit(None).cast(facts.schema["t"].dataType).alias("t"), F.lit(0).alias("o"), "v"), allowMissingColumns=True)
    )
    run = W.partitionBy("k", "slot").orderBy(F.col("t").asc_nulls_first(), "o").rowsBetween(W.unboundedPreceding, 0)
    found = lined.withColumn("v", F.last("v", ignorenulls=True).over(run)).where("o = 2")
    return found.select("row.*", *[F.col(f"v.{c}").alias(f"asof_{c}" if c in left.columns else c) for c in values], F.col("v.t").alias("asof_ts"))
