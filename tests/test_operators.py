from __future__ import annotations

import random

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars, clean, joins, metrics, monitor, patterns, signals, trades

T0 = datetime(2024, 1, 1)


def ticks(spark, rows):
    """rows: (instrument, seconds, seq, price, volume)."""
    data = [(i, T0 + timedelta(seconds=s), q, p, v) for i, s, q, p, v in rows]
    return spark.createDataFrame(data, "inst_id string, ts timestamp, seq long, last double, volume_24h double")


def test_envelopes(spark):
    ticker = {"instId": "BTC-USDT", "last": "2", "bidPx": "1", "askPx": "3", "bidSz": "1", "askSz": "1", "vol24h": "5", "high24h": "4", "low24h": "1", "open24h": "2", "ts": "1000", "new": 1}
    swap = ticker | {"instId": "BTC-USDT-SWAP", "last": "oops"}
    nameless = {k: v for k, v in ticker.items() if k != "instId"}
    raw = ['{"event":"subscribe"}', json.dumps({"data": []}), json.dumps({"data": [ticker, swap, nameless]}), "{broken", "", None]
    rows = clean.route(clean.parse_envelopes(spark.createDataFrame([(r,) for r in raw], "value string")))
    assert sorted((r.instId, r.market) for r in rows.collect()) == [("BTC-USDT", "spot"), ("BTC-USDT-SWAP", "swap")]
    good, bad = clean.strict_ods(clean.to_ods(rows, now=F.lit(1)))
    assert [r.inst_id for r in good.collect()] == ["BTC-USDT"]
    assert [(r.inst_id, r.missing) for r in bad.collect()] == [("BTC-USDT-SWAP", ["last_price"])]
    detail = clean.to_dwd(good, F.lit(2)).first()
    assert (float(detail.spread), detail.spread_rate, float(detail.price_change_24h), detail.amplitude_24h, detail.trade_hour) == (2.0, 1.0, 0.0, 3.0, 0)


def test_detail_guards(spark):
    rows = spark.createDataFrame([(1000, 2.0, 1.0, 3.0, 0.0, 5.0, 0.0), (1000, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1000, None, 1.0, 1.0, 1.0, 1.0, 1.0), (1000, -1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                 "timestamp long, last_price double, bid_price double, ask_price double, open_24h double, high_24h double, low_24h double")
    got = clean.to_dwd(rows, F.lit(0)).collect()
    assert len(got) == 1 and (float(got[0].price_change_24h), got[0].price_change_rate_24h, got[0].amplitude_24h) == (0.0, 0.0, 0.0)


def test_bars_order_ties_and_edges(spark):
    rows = ticks(spark, [("a", 0, 2, 5.0, 20.0), ("a", 0, 1, 4.0, 10.0), ("a", 59, 3, 9.0, 30.0), ("a", 60, 4, 1.0, 40.0), ("b", 30, 5, 7.0, None), ("a", 200, 6, 0.0, 1.0)])
    got = {(r.inst_id, r.window_start): r for r in bars.ohlc(rows).collect()}
    first = got["a", T0]
    assert (first.open, first.high, first.low, first.close, first.volume, first.tick_count, first.price_change_rate) == (4.0, 9.0, 4.0, 9.0, 30.0, 3, 1.25)
    assert got["a", T0 + timedelta(minutes=1)].open == 1.0 and got["b", T0].volume is None
    assert got["a", T0 + timedelta(minutes=3)].price_change_rate == 0.0


def test_rollup_equals_direct_bars(spark):
    rows = ticks(spark, [("a", s, s, float((s * 37) % 91 + 1), 1.0) for s in range(0, 3000, 7)])
    fine = bars.rollup(bars.ohlc(rows), "5 minutes").select("window_start", "open", "high", "low", "close", F.round("avg_price", 9).alias("m"), "tick_count")
    direct = bars.ohlc(rows, "5 minutes").select("window_start", "open", "high", "low", "close", F.round("avg_price", 9).alias("m"), "tick_count")
    assert sorted(fine.collect()) == sorted(direct.collect())


def test_interval_bounds(spark):
    a = spark.createDataFrame([("x", 100_000, 1), ("y", 100_000, 2)], "symbol string, a_ms long, a long")
    b = spark.createDataFrame([("x", 100_000 + d, d) for d in (-10_001, -10_000, 0, 10_000, 10_001)] + [("z", 100_000, 0)], "symbol string, b_ms long, d long")
    got = sorted((r.symbol, r.a, r.d) for r in joins.interval_join(a, b, "symbol", "a_ms", "b_ms").collect())
    assert got == [("x", 1, -10_000), ("x", 1, 0), ("x", 1, 10_000)]


def test_arbitrage_is_strict(spark):
    pairs = spark.createDataFrame([(1000.0, 1005.0), (1000.0, 1006.0), (1000.0, 994.0), (0.0, 5.0), (5.0, 0.0), (None, 1.0)], "spot_price double, future_price double")
    got = sorted((r.spread_rate, r.direction, r.profit_estimate) for r in joins.arbitrage(pairs).collect())
    assert got == [(-0.6, "SHORT_SPOT_LONG_FUTURE", 4.0), (0.6, "LONG_SPOT_SHORT_FUTURE", 4.0)]


def test_as_of_join(spark):
    left = spark.createDataFrame([("k", T0 + timedelta(hours=h), h) for h in (1, 30, 90)] + [("none", T0, 0)], "k string, at timestamp, h int")
    right = spark.createDataFrame([("k", T0 + timedelta(hours=h), h) for h in (2, 30, 31)], "k string, t timestamp, v int")
    got = {(r.k, r.h): r.v for r in joins.as_of_join(left, right, "k", "at", "t", ["v"]).collect()}
    assert got == {("k", 1): None, ("k", 30): 30, ("k", 90): 31, ("none", 0): None}


def test_fan_out_and_strategies(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, n int")
    configs = spark.createDataFrame([("*", "all", True), ("A", "one", True), ("A", "off", False), ("C", "other", True)], "symbol string, config_id string, enabled boolean")
    assert sorted((r.symbol, r.config_id) for r in joins.fan_out(rows, configs).collect()) == [("A", "all"), ("A", "one"), ("B", "all")]
    own = spark.createDataFrame([("A", 1.0, 2.0, 3.0, "AGGRESSIVE")], "symbol string, risk_threshold double, volume_threshold double, price_threshold double, strategy_type string")
    got = {r.symbol: (r.risk_threshold, r.strategy_type) for r in joins.with_strategy(rows, own).collect()}
    assert got == {"A": (1.0, "AGGRESSIVE"), "B": (50.0, "MODERATE")}
    assert [r.symbol for r in joins.allow_listed(rows, own).collect()] == ["A"]


def test_jumps_and_null_prices(spark):
    rows = ticks(spark, [("a", i, i, p, 1.0) for i, p in enumerate([100.0, 105.0, 110.4, None, 120.0])])
    flags = lambda df: [r.is_anomaly for r in df.orderBy("seq").collect()]
    assert flags(monitor.flag_jumps(rows)) == [False, False, True, False, True]
    assert flags(monitor.flag_jumps(rows, null_resets=True)) == [False, False, True, False, False]
    got = monitor.market_monitor(monitor.flag_jumps(rows)).first()
    assert (got.tick_count, got.anomaly_count, got.trend, got.change_percent) == (5, 2, monitor.RISING, 20.0)
    assert got.avg_price == round((100 + 105 + 110.4 + 120) / 5, 8)
    single = monitor.market_monitor(monitor.flag_jumps(ticks(spark, [("a", 0, 0, 3.0, 1.0)]))).first()
    assert (single.variance, single.trend) == (0.0, monitor.SIDEWAYS)


@pytest.mark.parametrize(("second", "matches"), [(299, 1), (300, 0)])
def test_breakout_time_limit(spark, second, matches):
    rows = ticks(spark, [("a", 0, 0, 1.0, 0.0), ("a", 1, 1, 2.0, 0.0), ("a", 2, 2, 3.0, 0.0), ("a", second, 3, 9.0, 0.0)])
    change = F.when(F.col("seq") == 3, 1.6).otherwise(0.1)
    assert patterns.breakouts(rows.withColumn("change_percent", change)).count() == matches


def test_breakout_overlaps_and_noise(spark):
    moves = [0.1, 0.2, 0.3, 0.4, 0.9, 1.6, 0.1, 1.0, 0.1, 0.1, 2.0]
    rows = spark.createDataFrame([("a", T0 + timedelta(seconds=i), i, float(i), m) for i, m in enumerate(moves)], "inst_id string, ts timestamp, seq long, last double, change_percent double")
    got = sorted((r.calm_price, r.break_seq) for r in patterns.breakouts(rows).collect())
    assert got == [(1.0, 5), (2.0, 5)]


def test_signal_rules(spark):
    base = {"price": 100.0, "volume": 500.0, "signal_count": 3, "volatility": 2.0, "volume_threshold": 400.0, "price_threshold": 2.0, "risk_threshold": 50.0}
    cases = [(3.0, 500.0, "AGGRESSIVE"), (-3.0, 500.0, "CONSERVATIVE"), (3.0, 400.0, "MODERATE"), (2.0, 500.0, "MODERATE"), (30.0, 1.0, "MODERATE")]
    rows = [(f"i{k}", T0, base["price"], c, v, 3, 2.0, 400.0, 2.0, 50.0, s) for k, (c, v, s) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "inst_id string, window_end timestamp, price double, change_percent double, volume double, signal_count int, volatility double, volume_threshold double, price_threshold double, risk_threshold double, strategy_type string")
    got = [(r.signal_type, r.target_price, r.stop_loss, r.confidence, r.risk_score) for r in signals.score(frame).orderBy("inst_id").collect()]
    assert got == [("BUY", 112.0, 96.0, 40.0, 35.0), ("SELL", 94.0, 104.0, 40.0, 35.0), ("HOLD", 100.0, 100.0, 20.0, 35.0), ("HOLD", 100.0, 100.0, 40.0, 30.0), ("HOLD", 100.0, 100.0, 20.0, 100.0)]
    assert signals.high_risk(signals.score(frame)).count() == 1


def test_trades(spark):
    rows = [(100, True, False), (103, False, False), (97.8, False, False), (100, True, False), (120, False, False), (113.9, False, False), (50, True, False), (51, False, True), (52, True, False)]
    data = [("a", T0 + timedelta(days=i), float(p), e, x) for i, (p, e, x) in enumerate(rows)]
    frame = spark.createDataFrame(data, "inst_id string, bar_time timestamp, close double, entry boolean, exit boolean")
    got = [(r.entry_price, r.exit_price, r.reason) for r in trades.trades(frame, trades.Exits(stop_loss=3.0, trailing=5.0)).orderBy("entry_time").collect()]
    assert got == [(100.0, 97.8, "trailing_stop"), (100.0, 113.9, "trailing_stop"), (50.0, 51.0, "signal"), (52.0, None, None)]
    multi = [(r.exit_price, r.reason) for r in trades.trades(frame.limit(3), trades.MULTI_LEVEL).collect()]
    assert multi == [(103.0, "level_1"), (97.8, "stop")]
    climb = [("a", T0 + timedelta(days=i), float(p), i == 0, False) for i, p in enumerate((100, 102, 103, 104.5, 99.2, 98.1, 97.9))]
    climbed = spark.createDataFrame(climb, frame.schema)
    multi = [(r.exit_price, r.reason) for r in trades.trades(climbed, trades.MULTI_LEVEL).collect()]
    assert multi == [(102.0, "level_1"), (104.5, "level_2"), (97.9, "stop")]  # the second level moved the stop from -1 to -2 percent


def test_slots_change_neither_breakouts_nor_jumps(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for k in range(900):
        at += rng.choice((0, 1, 5, 40, 400))
        rows.append((rng.choice("ab"), T0 + timedelta(seconds=at), k, rng.choice((None, 0.0, 100.0, 104.0, 106.0, 100.0)), rng.choice((0.1, 0.2, -0.3, 0.4, 1.0, 2.0, None))))
    frame = spark.createDataFrame(rows + [("a", None, 999, 5.0, 0.1)], "inst_id string, ts timestamp, seq long, last double, change_percent double")
    want = None
    for slot in (300, 301, 1000, 10**9):
        got = sorted(map(tuple, patterns.breakouts(frame, slot_seconds=slot).collect()))
        assert want in (None, got) and len(got) > 10
        want = got
    by_inst = {i: [r for r in rows if r[0] == i] for i in "ab"}
    plain = []
    for own in by_inst.values():
        for j in range(2, len(own)):
            if all(r[4] is not None and abs(r[4]) < 0.5 for r in own[j - 2 : j + 1]):
                jump = next((r for r in own[j + 1 :] if r[4] is not None and abs(r[4]) > 1.5), None)
                if jump and (jump[1] - own[j - 2][1]).total_seconds() < 300:
                    plain.append((own[j - 2][1], own[j][1], jump[2]))
    assert sorted((r[1], r[2], r[5]) for r in want) == sorted(plain)
    for resets in (False, True):
        flags = [sorted((r.seq, r.is_anomaly) for r in monitor.flag_jumps(frame, null_resets=resets, slot_seconds=slot).collect()) for slot in (60, 1000, 10**9)]
        assert flags[0] == flags[1] == flags[2] and 50 < sum(f for _, f in flags[0]) < 800


def test_many_configs_for_all(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, x int")
    configs = spark.createDataFrame([("*", f"c{i}", True) for i in range(20)] + [("a", "named", True), ("*", "off", False)], "symbol string, config string, enabled boolean")
    want = sorted(map(tuple, joins.fan_out(rows, configs).collect()))
    monkeypatch.setattr(joins, "MAX_STARRED", 3)
    assert sorted(map(tuple, joins.fan_out(rows, configs).collect())) == want and len(want) == 41


def test_rankings_and_overview(spark):
    rows = ticks(spark, [(i, s, s, 10.0 + k * (s % 5) + s / 100, float(k)) for k, i in enumerate("abc") for s in range(0, 600, 20)])
    out = metrics.realtime_metrics(bars.ohlc(rows))
    top = metrics.rankings(out, 2).where("ranking_type = 'VOLUME' and bars = 5").orderBy("window_end", "rank_no").collect()
    assert [r.inst_id for r in top[:2]] == ["c", "b"] and {r.rank_no for r in top} == {1, 2}
    row = metrics.market_overview(out).orderBy("window_end").collect()
    assert row[0].flat == 3 and row[1].total_symbols == 3


def test_dedup_window(spark):
    rows = spark.createDataFrame([("a", t, t) for t in (0, 4000, 9000, 20_000)], "k string, t long, seq long")
    assert sorted(r.t for r in clean.dedup_window(rows, ["k"], "t", "seq").collect()) == [0, 20_000]
    assert [r.t for r in clean.dedup_window(rows.where("t > 100000"), ["k"], "t", "seq").collect()] == []
