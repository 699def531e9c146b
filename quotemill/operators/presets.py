"""Signal presets: entry and exit rules by name, in families.

A family is a table of names and the parts from which its rule makes the two rules. Names in capitals
are fixed values, as are the lengths and limits beside them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import formulas as f
from quotemill.operators.indicators import Ind, close, compute, high, low, open_, volume

Rules = tuple[Ind, Ind]
x_up, x_down, over, under = f.crosses_up, f.crosses_down, f.over, f.under
sma, ema = f.sma, f.ema
_macd, _rsi = f.macd(close), f.rsi(close)
_signal = ema(_macd, 9)


def _cross(pairs: dict[str, tuple]) -> dict[str, Rules]:
    """Enter where the first line crosses the second upwards, leave where it crosses downwards."""
    return {name: (x_up(a, b), x_down(a, b)) for name, (a, b) in pairs.items()}


def _above(pairs: dict[str, tuple]) -> dict[str, Rules]:
    """Enter above the second line, leave below it."""
    return {name: (over(a, b), under(a, b)) for name, (a, b) in pairs.items()}


def _limits(rows: dict[str, tuple]) -> dict[str, Rules]:
    """Enter above the first limit, leave below the second."""
    return {name: (over(x, enter), under(x, leave)) for name, (x, enter, leave) in rows.items()}


def _reversals(rows: dict[str, tuple]) -> dict[str, Rules]:
    """Enter below the first limit, leave above the second."""
    return {name: (under(x, enter), over(x, leave)) for name, (x, enter, leave) in rows.items()}


def _cross_limits(rows: dict[str, tuple]) -> dict[str, Rules]:
    """Enter where the line crosses the first limit upwards, leave where it crosses the second downwards."""
    return {name: (x_up(x, enter), x_down(x, leave)) for name, (x, enter, leave) in rows.items()}


_trix = f.roc(ema(ema(ema(close, 15), 15), 15), 1)
_trix14 = f.roc(ema(ema(ema(close, 14), 14), 14), 1) * 100.0
_dma = sma(close, 10) - sma(close, 50)
_ad, _obv, _pvt = f.accumulation(), f.obv(), f.price_volume_trend()
_force = f.change(close) * volume
_stc = ema(close, 23) - ema(close, 50)
_srsi = sma(f.stochastic_of(_rsi, 14), 3)

MOVING_AVERAGES = _cross(
    {
        "SMA": (sma(close, 9), sma(close, 21)),
        "EMA": (ema(close, 9), ema(close, 21)),
        "WMA": (f.wma(close, 9), f.wma(close, 21)),
        "HMA": (f.hma(close, 9), f.hma(close, 21)),
        "KAMA": (f.kama(close), sma(close, 10)),
        "ZLEMA": (f.zlema(close, 9), f.zlema(close, 21)),
        "DEMA": (f.double_ema(close, 9), f.double_ema(close, 21)),
        "TEMA": (f.triple_ema(close, 9), f.triple_ema(close, 21)),
        "VWAP": (close, f.vwap(14)),
        "ICHIMOKU": (close, sma(close, 26)),
        "GOLDEN_CROSS": (sma(close, 9), sma(close, 26)),
        "DEATH_CROSS": (sma(close, 26), sma(close, 9)),
        "TRIMA": (sma(close, 9), sma(close, 21)),
        "T3": (ema(close, 10), sma(close, 10)),
        "MAMA": (f.kama(close, 20), sma(close, 20)),
        "VIDYA": (ema(close, 12), sma(close, 12)),
        "WILDERS": (f.wilder(close, 14), sma(close, 14)),
        "KVO": (close, sma(close, 34)),
        "HT_TRENDLINE": (close, sma(close, 14)),
        "HT_PHASOR": (close, ema(close, 14)),
        "VWMA": (close, f.vwma(20)),
        "SHOOTING_STAR": (close, sma(close, 20)),
        "MARUBOZU": (close, sma(close, 10)),
        "VWMA_CROSSOVER": (f.vwma(12), f.vwma(26)),
        "PRICE_PATTERN_RECOGNITION": (sma(close, 10), sma(close, 20)),
        "ADAPTIVE_MOVING_AVERAGE": (close, f.adaptive_mean()),
        "FRACTAL_ADAPTIVE_MA": (close, Ind("fractal_mean", (close, high, low), (20,))),
        "ZERO_LAG_EMA": (close, Ind("one_pole_slope", (close,), (20, 50))),
        "DOUBLE_EXPONENTIAL_MA": (close, Ind("ema_alpha", (close,), (0.1,)) * 2.0 - Ind("ema_alpha", (Ind("ema_alpha", (close,), (0.1,)),), (0.1,))),
        "TRIPLE_EXPONENTIAL_MA": (close, f.triple_ema(close, 20)),
        "VARIABLE_MA": (close, f.position_weighted(20)),
        "EHLERS_FILTER": (close, Ind("super_smoother", (close,), (20,))),
        "PARABOLIC_SAR": (close, f.parabolic()),
        "PARABOLIC_SAR_REVERSAL": (close, f.parabolic()),
        "GAUSSIAN_FILTER": (close, Ind("gaussian", (close,), (20, 4))),
        "BUTTERWORTH_FILTER": (close, Ind("two_pole", (close,), (20,))),
    }
)
MOVING_AVERAGES["HAMMER"] = (x_down(close, sma(close, 20)), x_up(close, sma(close, 20)))
MOVING_AVERAGES["TRIPLE_EMA"] = (
    over(ema(close, 5), ema(close, 10)) & over(ema(close, 10), ema(close, 20)),
    under(ema(close, 5), ema(close, 10)) & under(ema(close, 10), ema(close, 20)),
)

OSCILLATORS = _cross(
    {
        "MACD": (_macd, _signal),
        "PPO": (f.ppo(close), ema(f.ppo(close), 9)),
        "TRIX": (_trix, sma(_trix, 9)),
        "TRIX_SIGNAL": (_trix14, sma(_trix14, 9)),
        "DMA": (_dma, sma(_dma, 10)),
        "AROON": (f.aroon(25), f.aroon(25, False)),
        "RVGI": (f.rvgi(10), sma(f.rvgi(10), 4)),
        "STC": (_stc, ema(_stc, 10)),
        "VORTEX": (f.vortex(14), f.vortex(14, False)),
        "BBW": (f.band_width(), sma(f.band_width(), 10)),
        "VOLATILITY": (f.volatility(20), sma(f.volatility(20), 10)),
        "HT_DCPERIOD": (_rsi, sma(_rsi, 14)),
        "PRICE_OSCILLATOR": (sma(close, 12) - sma(close, 26), sma(sma(close, 12) - sma(close, 26), 9)),
    }
) | _cross_limits(
    {
        "WILLIAMS_R": (f.williams_r(14), -80.0, -20.0),
        "MSW": (f.williams_r(14), -80.0, -20.0),
        "CCI": (f.cci(20), -100.0, 100.0),
        "CMO": (f.cmo(close, 14), -50.0, 50.0),
        "ROC": (f.roc(close, 12), 0.0, 0.0),
        "DPO": (f.dpo(close, 20), 0.0, 0.0),
        "AWESOME_OSCILLATOR": (f.awesome(), 0.0, 0.0),
        "KDJ": (f.stoch_k(9) * 3.0 - sma(f.stoch_k(9), 3) * 2.0, 20.0, 80.0),
        "FISHER": (f.fisher(10), 0.0, 0.0),
        "FOSC": (f.forecast_oscillator(14), 0.0, 0.0),
        "QSTICK": (sma(close - open_, 14), 0.0, 0.0),
        "HT_SINE": (f.stoch_k(14), 20.0, 80.0),
        "NATR": (f.atr(14) / close * 100.0, 1.0, 0.5),
        "VOLUME_RSI": (f.rsi(volume), 30.0, 70.0),
        "ADAPTIVE_LAGUERRE": (Ind("laguerre_rsi", (close,), (0.2,)), 0.2, 0.8),
    }
)
OSCILLATORS |= {
    "RSI": (x_up(_rsi, 30.0), over(_rsi, 70.0)),
    "STOCHASTIC": (
        x_up(f.stoch_k(14), sma(f.stoch_k(14), 3)) & under(f.stoch_k(14), 20.0),
        x_down(f.stoch_k(14), sma(f.stoch_k(14), 3)) & over(f.stoch_k(14), 80.0),
    ),
    "STOCHASTIC_RSI": (x_up(_srsi, sma(_srsi, 3)) & under(_srsi, 25.0), x_down(_srsi, sma(_srsi, 3)) & over(_srsi, 75.0)),
    "CHOP": (x_down(f.choppiness(14), 38.2), x_up(f.choppiness(14), 61.8)),
    "MASS_INDEX": (x_down(f.mass_index(), 27.0), x_up(f.mass_index(), 27.0)),
    "DMI": (x_up(f.directional(), f.directional(14, False)) & over(f.adx(), 20.0), x_up(f.directional(14, False), f.directional()) & over(f.adx(), 20.0)),
    "ADX": (over(_rsi, 25.0) & over(close, sma(close, 14)), under(_rsi, 25.0) & under(close, sma(close, 14))),
    "MULTI_TIMEFRAME_MACD": (
        x_up(_macd, _signal) & x_up(f.macd(close, 24, 52), ema(f.macd(close, 24, 52), 18)),
        x_down(_macd, _signal) | x_down(f.macd(close, 24, 52), ema(f.macd(close, 24, 52), 18)),
    ),
    "ROC_DIVERGENCE": (
        over(f.roc(close, 12), 0.0) & x_up(f.roc(close, 12), sma(f.roc(close, 12), 5)),
        under(f.roc(close, 12), 0.0) & x_down(f.roc(close, 12), sma(f.roc(close, 12), 5)),
    ),
}

REVERSALS = _reversals(
    {
        "ADAPTIVE_RSI": (_rsi, 30.0, 70.0),
        "RSI_REVERSAL": (_rsi, 30.0, 70.0),
        "WILLIAMS_R_REVERSAL": (f.williams_r(14), -80.0, -20.0),
        "CONNORS_RSI": (f.connors(3), 20.0, 80.0),
        "ULTIMATE_OSCILLATOR": (f.ultimate(), 30.0, 70.0),
        "RELATIVE_MOMENTUM_INDEX": (f.relative_momentum(), 30.0, 70.0),
        "INTRADAY_MOMENTUM_INDEX": (f.intraday_momentum(), 30.0, 70.0),
        "MINUS_DIRECTIONAL_INDICATOR": (f.sum_directional(14, False), 15.0, 25.0),
        "ULCER_INDEX": (f.ulcer(close, 14), 5.0, 5.0),
        "COEFFICIENT_OF_VARIATION": (f.sd(close, 20) / sma(close, 20), 0.05, 0.15),
        "Z_SCORE": (f.z_score(close), -1.5, 1.5),
        "HISTORICAL_VOLATILITY": (f.historical_volatility(), sma(f.historical_volatility(), 10), sma(f.historical_volatility(), 10)),
    }
) | _limits(
    {
        "TRUE_STRENGTH_INDEX": (f.true_strength(close), 0.0, 0.0),
        "CYBER_CYCLE": (Ind("cyber_cycle", (close,), (0.07,)), 0.0, 0.0),
        "DIRECTIONAL_MOVEMENT_INDEX": (f.directional_index(), 20.0, 10.0),
        "PLUS_DIRECTIONAL_INDICATOR": (f.sum_directional(), 25.0, 15.0),
        "VERTICAL_HORIZONTAL_FILTER": (f.vertical_horizontal(), 0.35, 0.25),
        "VOLUME_RATE_OF_CHANGE": (f.roc(volume, 12), 50.0, -30.0),
        "BETA": (f.beta(close, 20), 1.2, 0.8),
        "CORREL": (f.lag_correlation(close), 0.3, -0.3),
        "SKEWNESS": (Ind("skewness", (close,), (20,)), 0.1, -0.1),
        "R_SQUARED": (f.r_squared(close), 0.6, 0.2),
        "LINEARREG_SLOPE": (f.slope(close), 0.1, -0.1),
        "LINEAR_REGRESSION_SLOPE": (f.slope(close), 0.1, -0.05),
        "LINEARREG_ANGLE": (Ind("arctan", (f.slope(close),)), 5.0, -5.0),
        "DETRENDED_PRICE_OSCILLATOR": (f.dpo(close, 20), 0.0, 0.0),
        "COPPOCK_CURVE": (f.roc(close, 14) + f.roc(close, 11), 0.0, 0.0),
    }
)

BANDS: dict[str, Rules] = {
    "BOLLINGER_BANDS": (under(close, f.band(close, 20, -2)), over(close, f.band(close, 20, 2))),
    "MEAN_REVERSION": (under(close, f.band(close, 20, -2)), over(close, f.band(close, 20, 2))),
    "STANDARD_DEVIATION_CHANNEL": (under(close, f.band(close, 20, -2)), over(close, f.band(close, 20, 2))),
    "STDDEV": (x_down(close, f.band(close, 20, -2)), x_up(close, f.band(close, 20, 2))),
    "PRICE_CHANNEL": (x_up(close, f.band(close, 20, 1.5)), x_down(close, f.band(close, 20, -1.5))),
    "KELTNER_CHANNEL": (x_down(close, f.keltner(20, -0.2, 14)), x_up(close, f.keltner(20, 0.2, 14))),
    "KELTNER_BREAKOUT": (x_up(close, f.keltner(20, 2, 10)), x_down(close, f.keltner(20, -2, 10))),
    "ATR_BREAKOUT": (x_up(close, sma(close, 20) + f.atr(14)), x_down(close, sma(close, 20) - f.atr(14))),
    "DONCHIAN_CHANNELS": (x_up(close, f.top(15)), x_down(close, f.bottom(15))),
    "SUPPORT_RESISTANCE_BREAKOUT": (x_up(close, f.top(15)), x_down(close, f.bottom(15))),
    "PERCENTILE": (under(close, f.percentile(close, 20, 25.0)), over(close, f.percentile(close, 20, 75.0))),
    "LINEARREG": (over(close, f.trend(close)), under(close, f.trend(close))),
    "TSF": (over(close, f.trend(close, 20, 1)), under(close, f.trend(close, 20, 1))),
    "LINEARREG_INTERCEPT": (over(f.intercept(close), sma(f.intercept(close), 10)), under(f.intercept(close), sma(f.intercept(close), 10))),
    "LINEAR_REGRESSION": (over(close, f.trend(close) * 1.01), under(close, f.trend(close) * 0.99)),
    "VAR": (over(Ind("variance", (close,), (20,)), sma(Ind("variance", (close,), (20,)), 10)), under(Ind("variance", (close,), (20,)), sma(Ind("variance", (close,), (20,)), 10))),
    "DUAL_THRUST": (
        over(close, sma(close, 14) + (sma(high, 14) - sma(low, 14)) * 0.5),
        under(close, sma(close, 14) - (sma(high, 14) - sma(low, 14)) * 0.5),
    ),
    "MAXIMUM_DRAWDOWN_CONTROL": (over(close, f.highest(close, 60) * 0.95), under(close, f.highest(close, 60) * 0.9)),
    "ARBITRAGE_STATISTICAL": (under(close, f.band(close, 60, -2)), over(close, f.band(close, 60, -0.5))),
    "CALENDAR_SPREAD": (under(sma(close, 30), sma(close, 90) * 0.95), over(sma(close, 30), sma(close, 90) * 1.05)),
}

VOLUMES = _cross(
    {
        "OBV": (_obv, sma(_obv, 20)),
        "AD": (sma(_ad, 3), sma(_ad, 10)),
        "ACCUMULATION_DISTRIBUTION": (_ad, sma(_ad, 10)),
        "PRICE_VOLUME_TREND": (_pvt, sma(_pvt, 10)),
        "WILLIAMS_ACCUMULATION": (f.williams_ad(), sma(f.williams_ad(), 14)),
        "NVI": (f.volume_index(True), sma(f.volume_index(True), 255)),
        "PVI": (f.volume_index(False), sma(f.volume_index(False), 255)),
        "NEGATIVE_VOLUME_INDEX": (f.volume_index(True), sma(f.volume_index(True), 255)),
        "NEGATIVE_VOLUME_INDEX_SIGNAL": (f.volume_index(True), sma(f.volume_index(True), 255)),
        "POSITIVE_VOLUME_INDEX_SIGNAL": (f.volume_index(False), sma(f.volume_index(False), 255)),
        "MARKETFI": ((high - low) / volume, sma((high - low) / volume, 14)),
    }
) | _cross_limits(
    {
        "EOM": (f.ease_of_movement(), 0.0, 0.0),
        "EASE_OF_MOVEMENT": (f.ease_of_movement(), 0.0, 0.0),
        "CHAIKIN_OSCILLATOR": (ema(_ad, 3) - ema(_ad, 10), 0.0, 0.0),
        "ADOSC": (ema(f.vwap(3), 3) - ema(f.vwap(3), 10), 0.0, 0.0),
        "VOSC": (f.volume_oscillator(5, 10), 0.0, 0.0),
        "VOLUME_OSCILLATOR_SIGNAL": (f.volume_oscillator(12, 26), 0.0, 0.0),
        "VOLUME_WEIGHTED_RSI": (f.volume_weighted_rsi(14), 30.0, 70.0),
    }
)
VOLUMES |= {
    "POSITIVE_VOLUME_INDEX": (VOLUMES["PVI"][1], VOLUMES["PVI"][0]),
    "FORCE_INDEX": (x_up(ema(_force, 2), ema(_force, 13)) & over(ema(_force, 2), 0.0), x_down(ema(_force, 2), ema(_force, 13)) & under(ema(_force, 2), 0.0)),
    "MONEY_FLOW_INDEX": (x_up(f.money_flow(), 20.0) & under(f.before(f.money_flow()), 20.0), x_down(f.money_flow(), 80.0) & over(f.before(f.money_flow()), 80.0)),
    "OBV_DIVERGENCE": (x_up(_obv, sma(_obv, 10)) & over(close, sma(close, 10)), x_down(_obv, sma(_obv, 10)) & under(close, sma(close, 10))),
    "ACCUMULATION_DISTRIBUTION_DIVERGENCE": (x_up(_ad, sma(_ad, 10)) & over(close, sma(close, 10)), x_down(_ad, sma(_ad, 10)) & under(close, sma(close, 10))),
    "PRICE_VOLUME_CONFIRMATION": (x_up(close, sma(close, 20)) & over(volume, sma(volume, 20) * 1.2), x_down(close, sma(close, 20)) & over(volume, sma(volume, 20) * 1.2)),
    "VOLUME_WEIGHTED_RSI_SIGNAL": (x_up(_rsi, 30.0) & over(f.rsi(volume), 50.0), x_down(_rsi, 70.0) & under(f.rsi(volume), 50.0)),
}

_sma20 = sma(close, 20)
CANDLES: dict[str, Rules] = {
    "DOJI": (f.doji() & under(close, _sma20), over(close, _sma20)),
    "BULLISH_ENGULFING": (f.engulfing() & under(close, _sma20), over(close, _sma20)),
    "BEARISH_ENGULFING": (under(close, _sma20), f.engulfing(False) & over(close, _sma20)),
    "BULLISH_HARAMI": (f.harami() & under(close, _sma20), over(close, _sma20)),
    "BEARISH_HARAMI": (under(close, _sma20), f.harami(False) & over(close, _sma20)),
    "THREE_WHITE_SOLDIERS": (f.three_in_a_row() | x_up(close, sma(close, 10)) | over(_rsi, 70.0), under(close, sma(close, 10))),
    "THREE_BLACK_CROWS": (over(close, _sma20) | x_up(close, sma(close, 10)) | under(_rsi, 30.0), f.three_in_a_row(False) | under(close, sma(close, 10))),
    "BALANCE_OF_POWER": (over((close - open_) / (high - low), 0.0), under((close - open_) / (high - low), 0.0)),
}

_sd10, _sd14, _sd30 = f.sd(close, 10), f.sd(close, 14), f.sd(close, 30)
_roc1 = f.roc(close, 1)
_between = lambda x, a, b: over(x, a) & under(x, b)
COMBINED: dict[str, Rules] = {
    "DUAL_MA_WITH_RSI": (x_up(sma(close, 9), sma(close, 21)) & over(_rsi, 50.0), x_down(sma(close, 9), sma(close, 21)) | under(_rsi, 50.0)),
    "TREND_FOLLOWING": (x_up(f.macd(close, 9, 26), ema(f.macd(close, 9, 26), 9)) & over(_rsi, 50.0), x_down(f.macd(close, 9, 26), ema(f.macd(close, 9, 26), 9)) | under(_rsi, 30.0)),
    "TURTLE_TRADING": (
        x_up(close, f.top(10)) & over(f.atr(), sma(f.atr(), 10)) & over(close, ema(close, 20)) & over(volume, sma(volume, 10)),
        x_down(close, f.bottom(5)) | x_down(close, ema(close, 20)),
    ),
    "TRIPLE_SCREEN": (x_up(close, _sma20) & over(_rsi, 50.0), x_down(close, _sma20)),
    "HT_DCPHASE": (under(_rsi, 30.0) & under(close, f.band(close, 20, -2)), over(_rsi, 70.0) | over(close, f.band(close, 20, 2))),
    "BOLLINGER_RSI_COMBO": (under(close, f.band(close, 20, -2)) & under(_rsi, 30.0), over(close, f.band(close, 20, 2)) & over(_rsi, 70.0)),
    "RSI_MACD_CONFIRMATION": (over(_rsi, 50.0) & over(_macd, _signal), under(_rsi, 50.0) & under(_macd, _signal)),
    "TRIPLE_INDICATOR_CONFIRMATION": (over(_rsi, 50.0) & over(_macd, _signal) & over(volume, sma(volume, 20)), under(_rsi, 50.0) & under(_macd, _signal) | under(volume, sma(volume, 20))),
    "MULTIPLE_MA_CONFIRMATION": (over(sma(close, 10), _sma20) & over(_sma20, sma(close, 50)), under(sma(close, 10), _sma20) & under(_sma20, sma(close, 50))),
    "MOMENTUM_BREAKOUT": (over(f.roc(close, 10), 5.0) & over(close, _sma20), under(f.roc(close, 10), -5.0) & under(close, _sma20)),
    "VOLATILITY_BREAKOUT_SYSTEM": (over(close, _sma20) & over(f.atr(), sma(f.atr(), 10)) & over(volume, sma(volume, 10) * 1.05), under(close, _sma20)),
    "TREND_STRENGTH": (over(f.adx(), sma(f.adx(), 10)) & over(close, _sma20), under(f.adx(), sma(f.adx(), 10) * 0.8) | under(close, _sma20)),
    "COMPREHENSIVE_SCORING": (over(_rsi, 40.0) & over(_macd, _signal) & over(close, _sma20), under(_rsi, 60.0) & under(_macd, _signal) & under(close, _sma20)),
    "NEURAL_NETWORK": (
        f.at_least(3, over(sma(close, 10), _sma20) & over(close, _sma20), over(_rsi, 45.0) & over(_macd, 0.0), over(volume, sma(volume, 10) * 1.1), under(_sd10, 1.5)),
        under(sma(close, 10), _sma20) | over(_rsi, 75.0) | under(_macd, 0.0),
    ),
    "SVM": (
        f.at_least(3, _between(_rsi, 35.0, 75.0), over(_macd, 0.0), over(close, _sma20), over(volume, sma(volume, 20) * 1.1), under(_sd14, 2.0)),
        under(close, _sma20) | over(_rsi, 80.0) | under(_macd, 0.0),
    ),
    "NAIVE_BAYES": (
        f.at_least(4, _between(_rsi, 35.0, 75.0), over(_macd, 0.0), over(f.roc(close, 10), -0.005), over(close, _sma20), over(volume, sma(volume, 15) * 1.05)),
        under(_rsi, 25.0) | over(_rsi, 80.0) | under(close, _sma20) | under(_macd, 0.0),
    ),
    "REINFORCEMENT_LEARNING": (over(_rsi, 35.0) & over(_macd, -0.001) | over(close, _sma20), under(_rsi, 65.0) & under(_macd, 0.001) | under(close, _sma20)),
    "MOMENTUM_FACTOR": (over(f.roc(close, 20), 0.02) & over(f.roc(close, 60), 0.05), under(f.roc(close, 20), -0.01)),
    "VALUE_FACTOR": (under(close, sma(close, 50)) & under(_rsi, 45.0), over(close, _sma20) | over(_rsi, 65.0)),
    "QUALITY_FACTOR": (under(_sd30, sma(_sd30, 20) * 1.2) & over(sma(close, 10), sma(close, 30)) | over(_rsi, 40.0), over(_sd30, sma(_sd30, 20) * 1.8) | under(sma(close, 10), sma(close, 30))),
    "SIZE_FACTOR": (under(close, sma(close, 252)) & under(volume, sma(volume, 252)), over(close, sma(close, 252))),
    "LOW_VOLATILITY_FACTOR": (under(_sd10, _sd30) & over(close, _sma20), over(_sd10, _sd30) | under(close, _sma20)),
    "MICROSTRUCTURE_IMBALANCE": (over(_roc1, 0.005) & over(f.roc(volume, 1), 0.5), under(_roc1, -0.002)),
    "MEAN_REVERSION_INTRADAY": (under(close, sma(close, 60)) & over(f.sd(close, 60), 1.0), over(close, sma(close, 60))),
    "MOMENTUM_INTRADAY": (over(f.roc(close, 15), 0.005) & over(f.roc(close, 15), sma(f.roc(close, 15), 30)), under(f.roc(close, 15), 0.0)),
    "VOLATILITY_SURFACE": (over(_sd10, _sd30 * 1.2), under(_sd10, _sd30)),
    "SEASONALITY": (over(sma(close, 21), sma(close, 63)) & over(close, sma(close, 21)), under(sma(close, 21), sma(close, 63))),
    "MACRO_MOMENTUM": (over(f.roc(close, 252), 0.15) & over(f.roc(close, 60), 0.05), under(f.roc(close, 252), 0.05)),
    "CORRELATION_FILTER": (over(_roc1, 0.01) & under(f.roc(volume, 1), 0.5), over(f.roc(volume, 1), 1.0)),
    "CHAOS_THEORY": (over(_sd10, sma(_sd10, 5)) | over(f.roc(close, 5), 0.01), under(f.roc(close, 5), 0.0) & under(_sd10, sma(_sd10, 5))),
    "NETWORK_ANALYSIS": (over(f.roc(close, 10), 0.01) | over(_sd10, sma(_sd10, 5)), under(f.roc(close, 10), -0.01) & under(_sd10, sma(_sd10, 5))),
    "FRACTAL_GEOMETRY": (over(_sd10, sma(_sd10, 5)) & over(f.roc(close, 20), 0.01), under(_sd10, sma(_sd10, 5)) | under(f.roc(close, 20), 0.0)),
}

#: A rule that never holds: exits that need an open position are the trades' matter.
NEVER = under(close, close)
_top20, _low20 = f.band(close, 20, 1.8), f.band(close, 20, -1.8)
_spans = (f.ichimoku(9) + f.ichimoku(26)) / 2.0
_mass5 = f.total(ema(high - low, 5) / ema(ema(high - low, 5), 5), 15)
_kurt = Ind("kurtosis", (close,), (20,))
_moment = close / f.before(close, 10) * 100.0
_hist8 = f.macd(close, 8, 17) - ema(f.macd(close, 8, 17), 6)
_squeezed = under(f.band(close, 20, 2), f.keltner(20, 1.5, 20)) & over(f.band(close, 20, -2), f.keltner(20, -1.5, 20))
_sdroc = f.sd(_roc1, 20)
_loud = lambda n, k: over(volume, sma(volume, n) * k)
_trendy = over(sma(close, 10), sma(close, 30))
_calm_rsi = over(_rsi, 45.0) & under(_rsi, 70.0)
_inside = under(close, _top20) & over(close, _low20)
_channel = x_up(close, f.top(20))

BREAKOUTS: dict[str, Rules] = {
    "SUPERTREND": (
        x_up(close, f.median + f.atr(7)) | over(close, ema(close, 20)) & over(close, f.median),
        x_down(close, f.median - f.atr(7)) | under(close, ema(close, 20)) & under(close, f.median),
    ),
    "ICHIMOKU_CLOUD_BREAKOUT": (x_up(close, _spans), x_down(close, f.ichimoku(52))),
    "CHANDELIER_EXIT": (
        x_up(close, f.top(11)) | x_down(close, f.bottom(11)),
        x_down(close, f.highest(high, 22) - f.atr(22) * 3.0) | x_up(close, f.lowest(low, 22) + f.atr(22) * 3.0),
    ),
    "ATR": (x_up(close, _sma20) & over(f.atr(7), sma(f.atr(7), 5) * 0.9), x_down(close, _sma20) | under(close, close - f.atr(7))),
    "BREAKOUT": (over(close, f.highest(high, 5) * 0.995) & over(close, ema(close, 20)), NEVER),
    "WILLIAMS_ALLIGATOR": (
        over(sma(f.median, 5), sma(f.median, 8)) & over(sma(f.median, 8), sma(f.median, 13)),
        under(sma(f.median, 5), sma(f.median, 8)) & under(sma(f.median, 8), sma(f.median, 13)),
    ),
    "MASS": (x_up(_mass5, sma(_mass5, 5)) & over(close, ema(close, 20)), x_down(_mass5, sma(_mass5, 5)) | x_down(close, ema(close, 20))),
    "SQUEEZE": (~_squeezed, _squeezed),
    "HT_TRENDMODE": (over(close, sma(close, 21)), under(close, sma(close, 21))),
    "ADAPTIVE_BOLLINGER": (x_down(close, f.adaptive_band(20, False)) & _loud(20, 1.05), x_up(close, _sma20) | over(close, f.before(close) * 1.03)),
    "VOLATILITY_BREAKOUT": (x_up(close, f.volatility_band()), x_down(close, f.volatility_band(top=False))),
    "PRICE_CHANNEL_BREAKOUT": (x_up(close, f.top(5)), x_down(close, f.bottom(5))),
    "DONCHIAN_BREAKOUT": (x_up(close, f.top(5)) & _loud(5, 0.8), x_down(close, f.bottom(5))),
    "VOLUME_BREAKOUT_CONFIRMATION": (x_up(close, f.top(15)) & _loud(20, 1.1), x_down(close, f.bottom(15))),
    "ELDER_RAY": (
        over(close, ema(close, 13)) & over(high - ema(close, 13), 0.0) & over(low - ema(close, 13), f.before(low - ema(close, 13))),
        under(close, ema(close, 13)) & under(low - ema(close, 13), 0.0) & under(high - ema(close, 13), f.before(high - ema(close, 13))),
    ),
    "KLINGER_OSCILLATOR": (x_up(f.klinger(), ema(f.klinger(), 13)), x_down(f.klinger(), ema(f.klinger(), 13))),
    "MACD_WITH_BOLLINGER": (
        (x_up(f.macd(close, 8, 17), ema(f.macd(close, 8, 17), 6)) | x_up(_hist8, 0.0)) & under(close, f.band(close, 15, -1.5) * 1.02) & under(_rsi, 45.0) & _loud(10, 1.0),
        x_down(f.macd(close, 8, 17), ema(f.macd(close, 8, 17), 6)) | x_down(_hist8, 0.0) | over(close, f.band(close, 15, 1.5) * 0.98) | over(_rsi, 60.0),
    ),
    "MOMENTUM_REVERSAL": (under(_rsi, 30.0) & over(f.divergence(), 0.5) & under(f.roc(close, 10), 0.0), over(_rsi, 70.0) | under(f.divergence(), -0.5)),
    "MOMENTUM_OSCILLATOR": (x_up(_moment, 100.0) & over(_moment, sma(_moment, 5)), x_down(_moment, 100.0) & under(_moment, sma(_moment, 5))),
    "KNOW_SURE_THING": (x_up(f.know_sure_thing(), sma(f.know_sure_thing(), 9)), x_down(f.know_sure_thing(), sma(f.know_sure_thing(), 9))),
}
BREAKOUTS |= _reversals(
    {
        "ROCKET_RSI": (f.rocket_rsi(), 25.0, 75.0),
        "STOCHASTIC_MOMENTUM": (f.after(14, f.or_neutral(f.stoch_k(14), f.highest(high, 14) - f.lowest(low, 14)), 50), 20.0, 80.0),
        "RAINBOW_OSCILLATOR": (f.rainbow(), 20.0, 80.0),
    }
) | _limits(
    {
        "COMMODITY_SELECTION_INDEX": (f.selection_index(), 20.0, -20.0),
        "TREND_INTENSITY_INDEX": (f.trend_intensity(), 60.0, 40.0),
        "MASS_INDEX_REVERSAL": (f.mass_index(9, 25), 27.0, 26.5),
        "RANDOM_WALK_INDEX": (f.random_walk(), 1.0, 0.5),
        "KURTOSIS": (_kurt, sma(_kurt, 10) * 1.1, sma(_kurt, 10) * 0.9),
    }
)
CANDLES |= {
    "HANGING_MAN": (under(close, sma(close, 10)) & over(close, f.before(close) * 0.98), f.hanging_man() | over(close, f.before(close) * 0.98)),
    "INVERTED_HAMMER": (f.inverted_hammer(), NEVER),
    "MORNING_STAR": (f.star(), NEVER),
    "EVENING_STAR": (f.star(False) | x_down(close, _sma20), x_up(close, _sma20)),
    "PIERCING": (f.piercing(), NEVER),
    "DARK_CLOUD_COVER": (f.dark_cloud(), NEVER),
}
VOTES: dict[str, Rules] = {
    "GENETIC_ALGORITHM": (
        f.at_least(2, x_up(sma(close, 10), sma(close, 30)), x_up(_rsi, 40.0), x_up(_macd, 0.0), _loud(20, 1.1)),
        x_down(sma(close, 10), sma(close, 30)) | over(_rsi, 65.0) | x_down(_macd, 0.0) | over(close, f.before(close) * 1.08),
    ),
    "RANDOM_FOREST": (
        f.at_least(3, over(sma(close, 10), _sma20) & over(close, _sma20), over(_rsi, 50.0) & over(_macd, 0.0), _loud(15, 1.3), under(_sd10, 2.0) & over(f.atr(), 0.01),
                   over(close, f.lowest(close, 15) + (f.highest(close, 15) - f.lowest(close, 15)) * 0.4)),
        under(sma(close, 10), _sma20) | over(_rsi, 75.0) | under(volume, sma(volume, 15) * 0.8),
    ),
    "LSTM": (
        f.at_least(2, under(_sd10, sma(_sd10, 5) * 1.2), _loud(30, 1.05), over(sma(close, 5), sma(close, 30)) & _between(f.rsi(close, 7), 40.0, 80.0)),
        under(sma(close, 5), sma(close, 30)) | over(f.rsi(close, 7), 80.0) | over(_sd10, 3.0),
    ),
    "KNN": (
        f.at_least(2, over(_roc1, 0.005) & over(_rsi, 45.0) & over(close, _sma20), _loud(10, 1.1) & under(f.sd(close, 5), 1.8) & over(_rsi, 40.0), _between(_rsi, 35.0, 75.0) & over(_roc1, 0.0)),
        under(_rsi, 30.0) | over(_rsi, 80.0) | under(close, _sma20),
    ),
    "DECISION_TREE": (
        over(_rsi, 45.0) & over(close, _sma20) & over(_macd, 0.0) & _loud(15, 1.1) | ~over(_rsi, 45.0) & under(_rsi, 35.0) & under(_sd10, 2.0) & _loud(15, 1.0),
        over(_rsi, 75.0) | under(_rsi, 25.0) | under(close, _sma20) | over(_sd10, 3.0),
    ),
    "ENSEMBLE": (
        _trendy | _calm_rsi & _inside | _calm_rsi & _channel | _inside & _channel,
        under(sma(close, 10), sma(close, 30)) | under(_rsi, 40.0) | over(_rsi, 75.0) | over(close, _top20) | under(close, _low20) | over(close, f.before(close) * 1.09),
    ),
    "PAIRS_TRADING": (under(close, f.band(close, 60, -2)), over(close, f.band(close, 60, -0.5))),
    "GAMMA_SCALPING": (over(_sdroc, sma(_sdroc, 10)) | over(_roc1, 0.005), under(_sdroc, sma(_sdroc, 10)) | under(_roc1, -0.005)),
    "VOLATILITY_MEAN_REVERSION": (over(f.sd(close, 20), sma(f.sd(close, 20), 60) * 2.0), under(f.sd(close, 20), sma(f.sd(close, 20), 60))),
    "VOLATILITY_MOMENTUM": (over(f.roc(_sd10, 5), 0.01), under(f.roc(_sd10, 5), -0.005)),
    "IMPLIED_VOLATILITY_RANK": (under(f.sd(close, 20), f.sd(close, 252) * 0.8), over(f.sd(close, 20), f.sd(close, 252) * 1.2)),
    "CARRY_TRADE": (over(sma(close, 5) - sma(close, 30), 0.0) | over(close, sma(close, 5)), under(close, sma(close, 5))),
    "FUNDAMENTAL_SCORE": (
        over(f.roc(close, 252), sma(f.roc(close, 252), 20)) & under(f.sd(close, 252), sma(f.sd(close, 252), 20) * 1.2) & _loud(252, 0.8),
        under(f.roc(close, 252), sma(f.roc(close, 252), 20) * 0.8),
    ),
    "SENTIMENT_ANALYSIS": (over(_roc1, 0.005) | _loud(20, 1.2), under(_roc1, -0.005) | over(f.sd(close, 20), 1.5)),
    "QUANTUM_INSPIRED": (over(f.roc(close, 10), 0.005) | _loud(20, 1.1), under(f.roc(close, 10), -0.005) | under(volume, sma(volume, 20) * 0.9) | over(close, f.before(close) * 1.05)),
    "KELLY_CRITERION": (over(_roc1, sma(_roc1, 14) * 0.5) & under(_sd14, sma(_sd14, 14) * 1.2), under(_roc1, 0.0) | over(_sd14, sma(_sd14, 14) * 1.5)),
    "VAR_RISK_MANAGEMENT": (under(_sdroc, sma(_sdroc, 10)), over(_sdroc, sma(_sdroc, 10) * 1.5)),
    "POSITION_SIZING": (under(f.sd(close, 20), sma(f.sd(close, 20), 20) * 1.2) & over(_roc1, sma(_roc1, 20) * 0.5), over(f.sd(close, 20), sma(f.sd(close, 20), 20) * 1.8)),
}

FAMILIES: dict[str, dict[str, Rules]] = {
    "moving_averages": MOVING_AVERAGES,
    "oscillators": OSCILLATORS,
    "reversals": REVERSALS,
    "bands": BANDS,
    "volumes": VOLUMES,
    "candles": CANDLES,
    "combined": COMBINED,
    "breakouts": BREAKOUTS,
    "votes": VOTES,
}
_cycle = ema(f.stochastic_of(f.macd(close, 23, 50), 10), 3)
_schaff = ema(f.stochastic_of(_cycle, 10), 3) * 100.0
_up20 = over(close, _sma20) | x_up(close, _sma20)
_up_macd = over(_macd, 0.0) | x_up(_macd, 0.0)
#: Presets beside the registered ones: earlier forms of some, and a few well-known additions.
OPTIONAL: dict[str, Rules] = {
    "DOUBLE_PUSH": (x_up(sma(close, 5), _sma20) & over(_rsi, 50.0), x_down(sma(close, 5), _sma20) & under(_rsi, 50.0)),
    "MULTI_LEVEL": (under(_rsi, 30.0) & x_up(close, _sma20), over(_rsi, 70.0)),
    "ADVANCED_MULTI_LEVEL": (x_up(_macd, _signal) & over(_rsi, 30.0) & under(_rsi, 70.0), NEVER),
    "TRIPLE_SCREEN_VOTES": (f.at_least(2, _up20, over(_rsi, 45.0), _up_macd), ~_up20 | under(_rsi, 40.0) | under(_macd, -0.0001)),
    "MEAN_REVERSION_BANDS": (under(close, f.band(close, 20, -1.5)), over(close, f.band(close, 20, 1.5)) | x_up(close, _sma20)),
    "VOLUME_CONFIRMATION": (over(f.roc(close, 5), 0.005) & _loud(10, 1.1) | over(f.roc(close, 5), 0.01), under(f.roc(close, 5), -0.005) | under(volume, sma(volume, 10))),
    "MOMENTUM_SHORT": (
        over(f.roc(close, 3), 0.003) & over(f.roc(close, 10), 0.002) & over(f.roc(close, 3), f.roc(close, 10)) | over(f.roc(close, 3), 0.01),
        under(f.roc(close, 3), 0.0) | under(f.roc(close, 3), f.roc(close, 10)),
    ),
    "SCHAFF_TREND_CYCLE": (x_up(_schaff, 25.0), x_down(_schaff, 75.0)),
    "PERCENT_RANK": (under(Ind("percent_rank", (close,), (20,)), 20.0), over(Ind("percent_rank", (close,), (20,)), 80.0)),
    "NET_MOMENTUM": (over(f.cmo(close, 14), 0.0), under(f.cmo(close, 14), 0.0)),
    "STOCHASTIC_INDICATOR": (x_up(f.stochastic_of(close, 14), 0.2), x_down(f.stochastic_of(close, 14), 0.8)),
}

#: Other names under which configurations ask for a preset.
ALIASES = {"MA": "SMA", "BOLL": "BOLLINGER_BANDS"}
PRESETS: dict[str, Rules] = {name: rules for family in FAMILIES.values() for name, rules in family.items()}


def _with_own_bar(rule: Ind | float) -> Ind | float:
    """The rule with channels that also hold the bar which is compared with them."""
    if not isinstance(rule, Ind):
        return rule
    below = rule.inputs[0] if rule.inputs else None
    if rule.op == "lag" and isinstance(below, Ind) and below.op in ("highest", "lowest") and below.inputs[0] in (high, low):
        return below
    return Ind(rule.op, tuple(map(_with_own_bar, rule.inputs)), rule.params)


def preset(name: str, include_current: bool = False) -> Rules:
    """The rules of a preset; ValueError for a name that isn't known.

    A price breaks out of the channel of the bars before its own. With include_current the channel holds its own bar
    too, as the source system has it; a close then never leaves it.
    """
    name = ALIASES.get(name.upper(), name.upper())
    if name not in PRESETS and name not in OPTIONAL:
        raise ValueError(f"unknown preset {name}")
    rules = PRESETS.get(name) or OPTIONAL[name]
    return (_with_own_bar(rules[0]), _with_own_bar(rules[1])) if include_current else rules  # type: ignore[return-value]


def preset_signals(bars: DataFrame, names: Iterable[str], strength: float = 80.0) -> DataFrame:
    """(inst_id, bar_time, close, preset, signal_type, strength): one row per bar and preset.

    Entry gives BUY, else exit gives SELL, else HOLD with strength 0. An instrument's first bar has no
    row: a signal needs two bars.
    """
    names = list(names)
    wanted = {f"{side}_{i}": rule for i, n in enumerate(names) for side, rule in zip(("in", "out"), preset(n), strict=True)}
    wanted["__bar"] = Ind("bar_number")
    out = compute(bars, wanted).where(F.col("__bar") >= 2)
    kind = lambda i: F.when(F.col(f"in_{i}"), "BUY").when(F.col(f"out_{i}"), "SELL").otherwise("HOLD")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), kind(i).alias("signal_type")) for i, n in enumerate(names)]))
    long = out.select("inst_id", "bar_time", "close", cells.alias("c")).select("inst_id", "bar_time", "close", "c.*")
    return long.withColumn("strength", F.when(F.col("signal_type") == "HOLD", 0.0).otherwise(strength))
