from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.operators import configured, presets
from quotemill.streaming import jobs
from tests.test_indicators import SCHEMA, T0, series, walk

LOG = "config_id string, changed_at timestamp, enabled boolean, symbol string, indicator_type string, indicator_name string, params map<string, string>"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def test_without_parameters_a_form_is_the_preset():
    for name in configured.FORMS:
        assert configured.configured(name)[2] == presets.preset(name), name
    assert configured.configured("ma", {"period": "5"}) == configured.configured("SMA", {"period": " 5", "other": "1"})
    for bad in ("x", "0", "-3", "nan", "inf", None):
        assert configured.settled("MACD", {"short_period": bad}) == configured.settled("MACD", {}), bad
    assert configured.settled("BOLLINGER_BANDS", {"k": "1.5"}) == (("period", 20), ("k", 1.5))


@pytest.mark.parametrize("name", ["DONCHIAN_CHANNELS", "SUPPORT_RESISTANCE_BREAKOUT", "PRICE_CHANNEL_BREAKOUT", "DONCHIAN_BREAKOUT", "VOLUME_BREAKOUT_CONFIRMATION", "TURTLE_TRADING", "CHANDELIER_EXIT"])
def test_channels_can_be_left(name):
    """The rule as written by the source system differs, and holds no lag of a channel."""
    assert presets.preset(name) != presets.preset(name, include_current=True)
    assert "'lag'" not in repr(presets.preset(name, include_current=True))


def test_breakouts_say_buy_and_sell(spark):
    bars = spark.createDataFrame(walk(3, 400), SCHEMA)
    names = ["DONCHIAN_CHANNELS", "SUPPORT_RESISTANCE_BREAKOUT", "PRICE_CHANNEL_BREAKOUT", "DONCHIAN_BREAKOUT", "VOLUME_BREAKOUT_CONFIRMATION", "TURTLE_TRADING", "CHANDELIER_EXIT"]
    said = {(r.preset, r.signal_type) for r in presets.preset_signals(bars, names).select("preset", "signal_type").distinct().collect()}
    assert said >= {(n, k) for n in names for k in ("BUY", "SELL")}


def test_each_bar_takes_its_own_parameters(spark):
    bars = spark.createDataFrame(walk(1, 60) + walk(2, 40), SCHEMA).cache()
    rows = [
        ("a", "*", "MA", "MA5", {"period": "5"}, True), ("b", "s1", "MA", "MA9", {"period": "9"}, True), ("c", "s2", None, "SMA", None, True),
        ("d", "*", "MA", "MA5", {"period": "5"}, False), ("e", "*", "NO_SUCH", "NOTHING", {}, True), ("f", "s9", "BOLL", "BOLL", {"k": "1"}, True),
    ]
    configs = spark.createDataFrame(rows, "config_id string, symbol string, indicator_type string, indicator_name string, params map<string, string>, enabled boolean")
    out = configured.configured_signals(bars, configs).cache()
    assert {(r.config_id, r.inst_id, r["count"]) for r in out.groupBy("config_id", "inst_id").count().collect()} == {("a", "s1", 59), ("a", "s2", 39), ("b", "s1", 59), ("c", "s2", 39)}
    c = series(bars, "close")
    got = series(out.where("config_id = 'b'"), "indicator_value")
    assert np.allclose(got, [c[max(0, i - 8) : i + 1].mean() for i in range(1, 60)])
    only = configured.configured_signals(bars, configs.where("config_id = 'b'"))
    assert only.count() == 59
    assert configured.configured_signals(bars, configs.where("false")).count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        configured.configured_signals(bars, configs, limit=1)


def test_a_log_becomes_intervals(spark):
    p, q = {"period": "5"}, {"period": "9"}
    rows = [
        ("a", at(0), True, "*", "MA", "x", p), ("a", at(1), True, "*", "MA", "x", p), ("a", at(5), True, "*", "MA", "x", q), ("a", at(8), False, "*", "MA", "x", q), ("a", at(9), False, "*", "MA", "x", p),
        ("a", at(12), True, "*", "MA", "x", q), ("b", at(3), False, "s", "MA", "x", p), ("b", at(4), True, "s", "MA", "x", None), ("c", None, True, "s", "MA", "x", p), ("d", at(2), True, "s", "MA", "x", p), ("d", at(2), True, "t", "MA", "x", p),
    ]
    got = {(r.config_id, r.symbol, (r.params or {}).get("period"), r.valid_from, r.valid_to) for r in configured.validity(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {("a", "*", "5", at(0), at(5)), ("a", "*", "9", at(5), at(8)), ("a", "*", "9", at(12), None), ("b", "s", None, at(4), None), ("d", "t", "5", at(2), None)}


@pytest.mark.parametrize("slot", [60, 600, 86_400])
def test_rows_meet_the_intervals_of_their_time(spark, slot):
    rng = random.Random(2)
    rows = [(rng.choice("st"), at(rng.randrange(300)), i) for i in range(120)] + [(None, at(5), 900), ("s", None, 901)]
    spans = [(f"c{i}", rng.choice(["s", "t", "*", "u"]), i, at(a := rng.randrange(300)), rng.choice([None, at(a), at(a + rng.randrange(200))])) for i in range(40)]
    frame = spark.createDataFrame(rows, "inst_id string, bar_time timestamp, n int")
    intervals = spark.createDataFrame(spans, "config_id string, symbol string, version int, valid_from timestamp, valid_to timestamp")
    got = sorted((r.n, r.config_id) for r in configured.valid_at(frame, intervals, slot_seconds=slot).collect())
    assert got == sorted((n, c) for k, t, n in rows for c, s, _, a, b in spans if s in (k, "*") and t is not None and a <= t and (b is None or t < b))


def test_a_removed_configuration_ends_its_signals(spark):
    bars = spark.createDataFrame(walk(1, 50), SCHEMA)
    rows = [("a", at(10), True, "s1", "MA", "MA5", {"period": "5"}), ("a", at(20), False, "s1", "MA", "MA5", {}), ("a", at(30), True, "*", "MA", "MA9", {"period": "9"})]
    out = configured.configured_signals(bars, configured.validity(spark.createDataFrame(rows, LOG)), intervals=True).cache()
    assert sorted(r.bar_time for r in out.collect()) == [at(i) for i in (*range(10, 20), *range(30, 50))]
    c = series(bars, "close")
    assert np.allclose(series(out, "indicator_value"), [c[i - 4 : i + 1].mean() for i in range(10, 20)] + [c[i - 8 : i + 1].mean() for i in range(30, 50)])


def test_a_stream_sees_changes_of_the_log(spark, tmp_path):
    """The log changes between two batches; a late row of the second still has the configuration of its time."""
    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    write = lambda rows, folder, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    write([("s1", at(1), 1), ("s1", at(3), 2), ("s2", at(3), 3)], feed, "inst_id string, ts timestamp, n int")
    write([("a", at(0), True, "*", "MA", "MA5", {"period": "5"})], log, LOG)
    stream = spark.readStream.schema("inst_id string, ts timestamp, n int").parquet(feed)
    run = lambda: jobs.stream_configured(stream, lambda s: s.read.parquet(log), str(tmp_path / "out"))
    assert run().count() == 3
    write([("a", at(4), False, "*", "MA", "MA5", {}), ("b", at(5), True, "s2", "MA", "MA9", {"period": "9"})], log, LOG)
    write([("s1", at(3), 4), ("s1", at(6), 5), ("s2", at(6), 6)], feed, "inst_id string, ts timestamp, n int")
    found = sorted((r.n, r.config_id, r.indicator_name) for r in run().select("n", "config_id", "indicator_name", F.col("params")).collect())
    assert found == [(1, "a", "MA5"), (2, "a", "MA5"), (3, "a", "MA5"), (4, "a", "MA5"), (6, "b", "MA9")]
