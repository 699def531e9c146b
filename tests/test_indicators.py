from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from quotemill.operators import formulas as f
from quotemill.operators import presets
from quotemill.operators.indicators import Ind, close, compute, high, low, register_indicator

T0 = datetime(2024, 1, 1)


def walk(seed: int, n: int) -> list[tuple]:
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        opened = price
        price = max(1.0, price + rng.gauss(0, 2))
        out.append((f"s{seed}", T0 + timedelta(minutes=i), opened, max(opened, price) + rng.random(), min(opened, price) - rng.random(), price, float(rng.randint(1, 99))))
    return out


SCHEMA = "inst_id string, bar_time timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(1, 150) + walk(2, 90), SCHEMA).cache()


def series(df, name: str, inst: str = "s1") -> np.ndarray:
    return np.array([r[name] for r in df.where(f"inst_id = '{inst}'").orderBy("bar_time").select(name).collect()], float)


def test_windows_equal_loops(bars):
    out = compute(bars, {"sma": f.sma(close, 5), "sd": f.sd(close, 5), "wma": f.wma(close, 4), "hi": f.highest(high, 7), "slope": f.slope(close, 6), "pct": f.percentile(close, 8, 25.0), "cci": f.cci(5)})
    c, h, lo = (series(bars, x) for x in ("close", "high", "low"))
    tail = lambda x, i, n: x[max(0, i - n + 1) : i + 1]
    at = range(len(c))
    assert np.allclose(series(out, "sma"), [tail(c, i, 5).mean() for i in at])
    assert np.allclose(series(out, "sd"), [tail(c, i, 5).std() for i in at])
    assert np.allclose(series(out, "wma"), [np.average(t, weights=range(1, len(t) + 1)) for t in (tail(c, i, 4) for i in at)])
    assert np.allclose(series(out, "hi"), [tail(h, i, 7).max() for i in at])
    assert np.allclose(series(out, "slope")[1:], [np.polyfit(range(len(t)), t, 1)[0] for t in (tail(c, i, 6) for i in at) if len(t) > 1])
    assert np.allclose(series(out, "pct"), [sorted(t)[max(0, -(-25 * len(t) // 100) - 1)] for t in (tail(c, i, 8) for i in at)])
    tp = (h + lo + c) / 3
    dev = [np.abs(tail(tp, i, 5) - tail(tp, i, 5).mean()).mean() for i in at]
    assert np.allclose(series(out, "cci")[1:], [(tp[i] - tail(tp, i, 5).mean()) / (0.015 * dev[i]) for i in at][1:])


def test_folds_equal_loops(bars):
    out = compute(bars, {"ema": f.ema(close, 9), "rsi": f.rsi(close, 14), "atr": f.atr(14), "kama": f.kama(close)})
    c = series(bars, "close")
    ema = [c[0]]
    for x in c[1:]:
        ema.append(ema[-1] + 0.2 * (x - ema[-1]))
    assert np.allclose(series(out, "ema"), ema)
    gain = loss = 0.0
    rsi = [0.0]
    for a, b in zip(c, c[1:], strict=False):
        gain += (max(b - a, 0) - gain) / 14
        loss += (max(a - b, 0) - loss) / 14
        rsi.append(100 * gain / (gain + loss))
    assert np.allclose(series(out, "rsi"), rsi)


RECURSIVE = {
    "ema": f.ema(close, 5), "macd": f.macd(close, 3, 6), "signal": f.ema(f.macd(close, 3, 6), 4), "triple": f.triple_ema(close, 7), "wilder": f.wilder(close, 14), "zlema": f.zlema(close, 9),
    "kama": f.kama(close, 10, 2, 30), "sar": f.parabolic(), "streak": Ind("streak", (close,)), "cycle": Ind("cyber_cycle", (close,), (0.07,)), "laguerre": Ind("laguerre_rsi", (close,), (0.2,)),
    "two_pole": Ind("two_pole", (close,), (20,)), "gaussian": Ind("gaussian", (close,), (20, 4)), "slope": Ind("one_pole_slope", (close,), (20, 50)), "smooth": Ind("super_smoother", (close,), (20,)),
    "fractal": Ind("fractal_mean", (close, high, low), (20,)), "alpha": Ind("ema_alpha", (close,), (0.1,)), "rsi_mean": f.ema(f.rsi(close, 5), 3), "slow": f.ema(close, 100_000),
}


@pytest.mark.parametrize("size", [7, 1000])
def test_slots_do_not_change_the_recurrences(spark, size):
    """All kinds, cut after every few bars; a mean of 100,000 bars still knows its start."""
    long = spark.createDataFrame(walk(5, 40 * size if size < 100 else 3000) + walk(6, 20), SCHEMA).cache()
    whole, cut = compute(long, RECURSIVE).cache(), compute(long, RECURSIVE, slot=size * 60.0).cache()
    for name in RECURSIVE:
        for inst in ("s5", "s6"):
            assert np.allclose(series(whole, name, inst), series(cut, name, inst), rtol=1e-11, atol=1e-11, equal_nan=True), name
    assert cut.count() == long.count()


def test_recurrences_equal_loops(bars):
    c, h, lo = (series(bars, x) for x in ("close", "high", "low"))
    out = compute(bars, RECURSIVE, slot=40 * 60.0).cache()
    at = range(len(c))
    streak, two, smooth, cycle, gauss, kama, fractal = [0.0], list(c[:2]), list(c[:2]), [0.0, 0.0], list(c[:20]), [c[0]], list(c[:20])
    fir = [c[i] if i < 3 else (c[i] + 2 * c[i - 1] + 2 * c[i - 2] + c[i - 3]) / 6 for i in at]
    beta = (1 - np.cos(np.pi / 10)) / (2**0.25 - 1)
    alpha = -beta + np.sqrt(beta**2 + 2 * beta)
    for i in at[1:]:
        streak.append(max(streak[-1], 0) + 1 if c[i] > c[i - 1] else min(streak[-1], 0) - 1)
        moves = sum(abs(c[k] - c[k - 1]) for k in range(max(1, i - 9), i + 1))
        kama.append(kama[-1] + ((abs(c[i] - c[max(0, i - 10)]) / moves) * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - kama[-1]))
        if i < 2:
            continue
        for values, root, mean in ((two, 2**0.5, (c[i] + 2 * c[i - 1] + c[i - 2]) / 4), (smooth, 1.414, (c[i] + c[i - 1]) / 2)):
            a = np.exp(-root * np.pi / 20)
            b = 2 * a * np.cos(root * np.pi / 20)
            values.append((1 - b + a * a) * mean + b * values[-1] - a * a * values[-2])
        cycle.append(0.965**2 * (fir[i] - 2 * fir[i - 1] + fir[i - 2]) + 2 * 0.93 * cycle[-1] - 0.93**2 * cycle[-2])
        if i >= 20:
            v = c[i]
            for _ in range(4):
                v = alpha * v + (1 - alpha) * gauss[-1]
            gauss.append(v)
            span = lambda a, b: max(h[a:b]) - min(lo[a:b])
            size = np.log2((span(i - 19, i - 9) + span(i - 9, i + 1)) / 10 / (span(i - 19, i + 1) / 20))
            weight = min(max(np.exp(-4.6 * (min(max(size, 1), 2) - 1)), 0.01), 1)
            fractal.append(fractal[-1] + weight * (c[i] - fractal[-1]))
    for name, want in {"streak": streak, "two_pole": two, "smooth": smooth, "cycle": cycle, "gaussian": gauss, "kama": kama, "fractal": fractal}.items():
        assert np.allclose(series(out, name), want), name


def test_a_long_streak_crosses_slots(spark):
    rows = [("x", T0 + timedelta(minutes=i), *[float(i if i != 2500 else 0)] * 4, 1.0) for i in range(3000)]
    out = compute(spark.createDataFrame(rows, SCHEMA), {"s": Ind("streak", (close,))}, slot=60_000.0)
    assert [int(x) for x in series(out, "s", "x")] == [*range(2500), -1, *range(1, 500)]


def test_nulls_at_the_start_of_a_slot(spark):
    prices = [1.0, 2.0, None, None, None, 3.0, 1.0, None]
    out = {}
    for slot in (120.0, 6000.0):
        rows = [("x", T0 + timedelta(minutes=i), p, p, p, p, 1.0) for i, p in enumerate(prices)]
        frame = spark.createDataFrame(rows, SCHEMA)
        out[slot] = [series(compute(frame, RECURSIVE, slot=slot), n, "x") for n in ("ema", "signal", "laguerre", "streak", "alpha")]
    assert np.allclose(out[120.0], out[6000.0], equal_nan=True) and not np.isnan(out[120.0]).any()


WINDOWS = {
    "wma": f.wma(close, 9), "hull": f.hma(close, 12), "percentile": f.percentile(close, 20, 25.0), "rank": Ind("percent_rank", (close,), (15,)), "cci": f.cci(11), "aroon": f.aroon(25), "bottom": f.aroon(14, False),
    "some": Ind("mean_of_last", (close, f.stoch_k(9) / 10.0 + 1.0), (8,)), "median": f.percentile(close, 1, 50.0),
}


@pytest.mark.parametrize("slot", [5 * 60.0, 40 * 60.0, 1e9])
def test_long_windows_pass_by_as_scans(bars, slot):
    """With `listed` 0 no operation makes a list; slots may be shorter than the windows."""
    lists, passed = compute(bars, WINDOWS).cache(), compute(bars, WINDOWS, slot=slot, listed=0).cache()
    for name in WINDOWS:
        for inst in ("s1", "s2"):
            assert np.allclose(series(lists, name, inst), series(passed, name, inst), rtol=1e-9, atol=1e-9), name


def test_a_window_of_thousands(spark):
    """Ties and long windows: against plain Python on every 97th bar."""
    rng, n = random.Random(4), 4000
    rows = [("x", T0 + timedelta(minutes=i), *[float(rng.randrange(60))] * 4, 1.0) for i in range(n)]
    wanted = {"wma": f.wma(close, 1500), "percentile": f.percentile(close, 1500, 90.0), "rank": Ind("percent_rank", (close,), (1500,)), "since": Ind("since_extreme", (close,), (1500, 1)), "dev": Ind("mean_deviation", (close,), (1500,))}
    out = compute(spark.createDataFrame(rows, SCHEMA), wanted, slot=60_000.0).cache()
    c = [r[2] for r in rows]
    got = {k: series(out, k, "x") for k in wanted}
    for i in range(0, n, 97):
        w = c[max(0, i - 1499) : i + 1]
        assert abs(got["wma"][i] - np.average(w, weights=range(1, len(w) + 1))) < 1e-9
        assert got["percentile"][i] == sorted(w)[max(0, -(-90 * len(w) // 100) - 1)]
        assert abs(got["rank"][i] - sum(x <= c[i] for x in w) * 100 / len(w)) < 1e-9
        assert got["since"][i] == len(w) - 1 - max(k for k, x in enumerate(w) if x == max(w))
        assert abs(got["dev"][i] - np.abs(np.array(w) - np.mean(w)).mean()) < 1e-9


def test_a_null_leaves_a_fold_alone(spark):
    rows = [("x", T0 + timedelta(minutes=i), p, p, p, p, 1.0) for i, p in enumerate([None, 100.0, 100.0, None, 100.0, 106.0, None, 100.0])]
    got = [r.e for r in compute(spark.createDataFrame(rows, SCHEMA), {"e": f.ema(close, 2)}).orderBy("bar_time").collect()]
    assert got[0] is None or np.isnan(got[0])
    assert np.allclose(got[1:], [100, 100, 100, 100, 104, 104, 100 + 4 / 3])


def test_flat_and_short_input_is_neutral(spark):
    rows = [("x", T0 + timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(30)]
    flat = spark.createDataFrame(rows, SCHEMA)
    names = ["STOCHASTIC_MOMENTUM", "RELATIVE_MOMENTUM_INDEX", "INTRADAY_MOMENTUM_INDEX", "TREND_INTENSITY_INDEX", "VOLUME_WEIGHTED_RSI", "MONEY_FLOW_INDEX"]
    assert {r.signal_type for r in presets.preset_signals(flat, names).collect()} == {"HOLD"}
    # until as many bars are there as the length says, the value is neutral, whatever the prices do
    few = spark.createDataFrame(walk(9, 13) + walk(12, 13), SCHEMA)
    assert {r.signal_type for r in presets.preset_signals(few, [*names, "ROCKET_RSI"]).collect()} == {"HOLD"}
    early = {"rmi": (f.relative_momentum(14, 5), 19, 50), "kst": (f.know_sure_thing(), 30, 0), "rainbow": (f.rainbow(), 20, 0), "vhf": (f.vertical_horizontal(28), 28, 0), "rwi": (f.random_walk(14), 14, 0), "csi": (f.selection_index(14), 14, 0)}
    out = compute(spark.createDataFrame(walk(9, 60), SCHEMA), {k: v for k, (v, _, _) in early.items()})
    for name, (_, n, value) in early.items():
        got = series(out, name, "s9")
        assert (got[:n] == value).all() and (got[n : n + 5] != value).any(), name


def test_connors_equals_a_loop(bars):
    c = series(bars, "close")

    def strength(x: list, n: int) -> list:
        gain = loss = 0.0
        out = [0.0]
        for a, b in zip(x, x[1:], strict=False):
            gain += (max(b - a, 0) - gain) / n
            loss += (max(a - b, 0) - loss) / n
            out.append(100 * gain / (gain + loss) if gain + loss else 0.0)
        return out

    run = [0.0]
    for a, b in zip(c, c[1:], strict=False):
        run.append(max(run[-1], 0) + 1 if b > a else min(run[-1], 0) - 1)
    price, streaks = strength(list(c), 3), strength(run, 3)
    want = [50.0 if i < 3 else (price[i] + streaks[i] + sum(x < c[i] for x in c[i - 2 : i + 1]) / 3 * 100) / 3 for i in range(len(c))]
    assert np.allclose(series(compute(bars, {"c": f.connors(3)}), "c"), want)


def test_crossing_with_ties(spark):
    prices = [1, 1, 2, 2, 3, 2, 2, 1, 2, 3]
    rows = [("x", T0 + timedelta(minutes=i), float(p), float(p), float(p), float(p), 1.0) for i, p in enumerate(prices)]
    out = compute(spark.createDataFrame(rows, SCHEMA), {"up": f.crosses_up(close, 2.0), "down": f.crosses_down(close, 2.0)})
    got = out.orderBy("bar_time").collect()
    assert [i for i, r in enumerate(got) if r.up] == [4, 9] and [i for i, r in enumerate(got) if r.down] == [7]


@pytest.mark.parametrize("family", [*presets.FAMILIES, "optional"])
def test_presets_build_and_say_one_of_three(bars, family):
    names = presets.FAMILIES.get(family, presets.OPTIONAL)
    out = presets.preset_signals(bars, names)
    assert {r.signal_type for r in out.select("signal_type").distinct().collect()} <= {"BUY", "SELL", "HOLD"}
    assert out.count() == (bars.count() - 2) * len(names)


def test_names(spark, bars):
    assert len(presets.PRESETS) == 239
    assert presets.preset("ma") == presets.preset("SMA") and presets.preset("BOLL") == presets.preset("BOLLINGER_BANDS")
    with pytest.raises(ValueError, match="unknown preset"):
        presets.preset("NO_SUCH")
    double = register_indicator("doubled", lambda run, rows, a, k: a * k)
    out = compute(bars, {"d": double(close, k=2.0)})
    assert np.allclose(series(out, "d"), 2 * series(bars, "close"))
    with pytest.raises(ValueError, match="taken"):
        register_indicator("doubled", lambda *a: a[0])
    peak = register_indicator("peak", lambda state, x: ((max(x, *state),), max(x, *state)) if state else ((x,), x), recursive=True)
    assert np.allclose(series(compute(bars, {"p": peak(close)}), "p"), np.maximum.accumulate(series(bars, "close")))
    with pytest.raises(ValueError, match="unknown indicator"):
        compute(bars, {"x": Ind("nothing", (close, low))})
