"""Named indicators built from the basic ones."""

from __future__ import annotations

import math

from quotemill.operators.indicators import Ind, close, high, low, open_, volume


def sma(x, n):
    return Ind("sma", (x,), (n,))


def ema(x, n):
    return Ind("ema", (x,), (n,))


def wma(x, n):
    return Ind("wma", (x,), (n,))


def wilder(x, n):
    return Ind("wilder", (x,), (n,))


def sd(x, n):
    return Ind("sd", (x,), (n,))


def lag(x, n=1):
    return Ind("lag", (x,), (n,))


def before(x, n=1):
    """The value n bars ago; where there is none, the value itself."""
    return Ind("lag_or_self", (x,), (n,))


def highest(x, n):
    return Ind("highest", (x,), (n,))


def lowest(x, n):
    return Ind("lowest", (x,), (n,))


def top(n):
    """The upper end of the channel that the n bars before this one form."""
    return lag(highest(high, n))


def bottom(n):
    return lag(lowest(low, n))


def total(x, n):
    return Ind("total", (x,), (n,))


def running(x):
    return Ind("cumulative", (x,))


def over(a, b):
    return Ind("over", (a, b))


def under(a, b):
    return Ind("under", (a, b))


def crosses_up(a, b):
    return Ind("crossed", (Ind("sign", (a, b)), 1.0))


def crosses_down(a, b):
    return Ind("crossed", (Ind("sign", (a, b)), -1.0))


def at_least(k, *rules):
    return Ind("at_least", rules, (k,))


def choose(condition, yes, no):
    return Ind("choose", (condition, yes, no))


def positive_part(x):
    return Ind("larger", (x, 0.0))


def negative_part(x):
    return Ind("larger", (x * -1.0, 0.0))


def change(x, n=1):
    return x - before(x, n)


def roc(x, n):
    """Percent change over n bars."""
    return (x - before(x, n)) / before(x, n) * 100.0


def hma(x, n):
    return wma(wma(x, n // 2) * 2.0 - wma(x, n), round(math.sqrt(n)))


def double_ema(x, n):
    e = ema(x, n)
    return e * 2.0 - ema(e, n)


def triple_ema(x, n):
    a = ema(x, n)
    b = ema(a, n)
    return a * 3.0 - b * 3.0 + ema(b, n)


def zlema(x, n):
    return Ind("zlema", (x,), (n,))


def kama(x, n=10, fast=2, slow=30):
    return Ind("kama", (x,), (n, fast, slow))


def macd(x, short=12, long=26):
    return ema(x, short) - ema(x, long)


def ppo(x, short=12, long=26):
    return macd(x, short, long) / ema(x, long) * 100.0


def rsi(x, n=14):
    gain, loss = wilder(positive_part(change(x)), n), wilder(negative_part(change(x)), n)
    return gain / (gain + loss) * 100.0


def or_neutral(value, base):
    """The value, or 50 where its divisor is 0: neither side has moved."""
    return choose(over(base, 0.0), value, 50.0)


def after(n, value, early):
    """`early` until n earlier bars are there: what the source system gives for a short input."""
    return choose(over(Ind("bar_number"), float(n)), value, float(early))


def neutral_share(p, m):
    """p as a percentage of p and m, 50 where both are 0."""
    return or_neutral(p / (p + m) * 100.0, p + m)


def stoch_k(n=14):
    return (close - lowest(low, n)) / (highest(high, n) - lowest(low, n)) * 100.0


def stochastic_of(x, n=14):
    return (x - lowest(x, n)) / (highest(x, n) - lowest(x, n))


def williams_r(n=14):
    return (highest(high, n) - close) / (highest(high, n) - lowest(low, n)) * -100.0


typical = (high + low + close) / 3.0
median = (high + low) / 2.0


def cci(n=20):
    return (typical - sma(typical, n)) / (Ind("mean_deviation", (typical,), (n,)) * 0.015)


def cmo(x, n=14):
    gain, loss = total(positive_part(change(x)), n), total(negative_part(change(x)), n)
    return (gain - loss) / (gain + loss) * 100.0


def dpo(x, n=20):
    return x - before(sma(x, n), n // 2 + 1)


def aroon(n=25, top=True):
    return (Ind("since_extreme", (high if top else low,), (n + 1, int(top))) * -1.0 + float(n)) / float(n) * 100.0


def true_range():
    c = before(close)
    return Ind("larger", (high - low, Ind("abs", (high - c,)), Ind("abs", (low - c,))))


def atr(n=14):
    return wilder(true_range(), n)


def simple_atr(n=14):
    return sma(true_range(), n)


def ulcer(x, n=14):
    drop = (x - highest(x, n)) / highest(x, n) * 100.0
    return Ind("root", (sma(drop * drop, n),))


def band(x, n, k):
    """Mean of n bars and k deviations: up for a positive k, down for a negative one."""
    return sma(x, n) + sd(x, n) * float(k)


def keltner(n, k, m):
    return ema(close, n) + atr(m) * float(k)


def vwap(n=14):
    return total(typical * volume, n) / total(volume, n)


def vwma(n=20):
    return total(close * volume, n) / total(volume, n)


def directional(n=14, plus=True):
    """Directional movement as a percentage of the average true range."""
    up, down = high - before(high), before(low) - low
    move = choose(over(up, down) & over(up, 0.0), up, 0.0) if plus else choose(over(down, up) & over(down, 0.0), down, 0.0)
    return wilder(move, n) / atr(n) * 100.0


def adx(n=14):
    p, m = directional(n), directional(n, False)
    return wilder(Ind("abs", (p - m,)) / (p + m) * 100.0, n)


def obv():
    return running(Ind("choose", (over(close, before(close)), volume, Ind("choose", (under(close, before(close)), volume * -1.0, 0.0)))))


def accumulation():
    return running(((close - low) - (high - close)) / (high - low) * volume)


def price_volume_trend():
    return running(change(close) / before(close) * volume)


def williams_ad():
    return running(change(close) / (high - low))


def volume_index(falling: bool):
    """Compound return of the bars with falling (or rising) volume; starts at 1000."""
    moved = under(volume, before(volume)) if falling else over(volume, before(volume))
    return Ind("compounded", (choose(moved, change(close) / before(close), 0.0), 1000.0))


def mass_index(n=9, m=25):
    e = ema(high - low, n)
    return total(e / ema(e, n), m)


def ichimoku(n):
    return (highest(high, n) + lowest(low, n)) / 2.0


def awesome():
    return sma(median, 5) - sma(median, 34)


def fisher(n=10):
    z = (close - lowest(close, n)) / (highest(close, n) - lowest(close, n)) * 2.0 - 1.0
    inside = under(Ind("abs", (z,)), 1.0)
    return choose(inside, Ind("log", ((z + 1.0) / (z * -1.0 + 1.0),)) * 0.5, 0.0)


_bar = Ind("bar_number")


def trend(x, n=20, ahead=0):
    return Ind("trend_value", (x, _bar), (n, ahead))


def slope(x, n=20):
    return Ind("slope", (x, _bar), (n,))


def intercept(x, n=20):
    """The regression line at the oldest bar of the window."""
    return trend(x, n, -(n - 1))


def r_squared(x, n=20):
    return Ind("r_squared", (x, _bar), (n,))


def forecast_oscillator(n=14):
    return (close - trend(close, n)) / close * 100.0


def ease_of_movement(n=14, scale=1e8):
    return sma(change(median) * scale / (volume / (high - low)), n)


def choppiness(n=14):
    return Ind("log", (total(true_range(), n) / (highest(high, n) - lowest(low, n)),)) / math.log(10) / math.log10(n) * 100.0


def rvgi(n=10):
    return total(close - open_, n) / total(high - low, n)


def vortex(n=14, plus=True):
    move = high - before(low) if plus else low - before(high)
    return total(Ind("abs", (move,)), n) / total(true_range(), n)


def band_width(n=20, k=2):
    return sd(close, n) * float(2 * k) / sma(close, n)


def log_return():
    return Ind("log", (close / before(close),))


def volatility(n=20):
    return sd(log_return(), n) * math.sqrt(252)


def historical_volatility(n=20):
    return Ind("root", (sma(log_return() * log_return(), n),))


def volume_oscillator(short, long):
    return (sma(volume, short) - sma(volume, long)) / sma(volume, long) * 100.0


def money_flow(n=14):
    flow = typical * volume
    up, down = over(typical, before(typical)), under(typical, before(typical))
    p, m = total(choose(up, flow, 0.0), n), total(choose(down, flow, 0.0), n)
    return after(n, neutral_share(p, m), 50)


def volume_weighted_rsi(n=14):
    p, m = total(positive_part(change(close)) * volume, n), total(negative_part(change(close)) * volume, n)
    return after(n, neutral_share(p, m), 50)


def beta(x, n=20):
    base = sma(x, n)
    a, b = change(x) / before(x), change(base) / before(base)
    return Ind("smaller", (Ind("larger", (total(a * b, n) / total(b * b, n), 0.0)), 3.0))


def lag_correlation(x, n=20, by=5):
    return Ind("correlation", (x, before(x, by)), (n,))


def z_score(x, n=20):
    return (x - sma(x, n)) / sd(x, n)


def percentile(x, n, p):
    return Ind("percentile", (x,), (n, p))


def true_strength(x, long=25, short=13):
    c = change(x)
    return ema(ema(c, long), short) / ema(ema(Ind("abs", (c,)), long), short) * 100.0


def ultimate(a=7, b=14, c=28):
    bottom = Ind("smaller", (low, before(close)))
    press = lambda n: total(close - bottom, n) / total(true_range(), n)
    return (press(a) * 4.0 + press(b) * 2.0 + press(c)) / 7.0 * 100.0


def sum_directional(n=14, plus=True):
    up, down = high - before(high), before(low) - low
    move = choose(over(up, down) & over(up, 0.0), up, 0.0) if plus else choose(over(down, up) & over(down, 0.0), down, 0.0)
    return after(n, total(move, n) / total(true_range(), n) * 100.0, 0)


def directional_index(n=14):
    p, m = sum_directional(n), sum_directional(n, False)
    return Ind("abs", (p - m,)) / (p + m) * 100.0  # 0 as long as both are


def vertical_horizontal(n=28):
    return after(n, (highest(close, n) - lowest(close, n)) / total(Ind("abs", (change(close),)), n), 0)


def relative_momentum(n=14, by=5):
    p, m = total(positive_part(change(close, by)), n), total(negative_part(change(close, by)), n)
    return after(n + by, neutral_share(p, m), 50)


def intraday_momentum(n=14):
    p, m = total(positive_part(close - open_), n), total(negative_part(close - open_), n)
    return after(n, neutral_share(p, m), 50)


def count_below(x, n):
    """How many of the last n values lie strictly below this one."""
    parts = [choose(under(lag(x, k), x), 1.0, 0.0) for k in range(1, n)]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def connors(n=3):
    """Mean of the strength of price and of its streak and of the share of the last n closes below; 50 until n earlier bars are there."""
    mean = (rsi(close, n) + rsi(Ind("streak", (close,)), n) + count_below(close, n) / float(n) * 100.0) / 3.0
    return choose(over(_bar, float(n)), mean, 50.0)


def parabolic(step=0.02, most=0.2):
    return Ind("sar", (high, low), (step, most))


def volatility_band(n=5, k=0.5, top=True):
    """Highest close plus (lowest minus) k average ranges."""
    edge = highest(close, n) if top else lowest(close, n)
    return edge + atr(n) * float(k if top else -k)


def adaptive_band(n=20, top=True):
    """Band whose width follows the deviation against its own ten-bar mean, between 1.5 and 2.5."""
    s = sd(close, n)
    k = Ind("smaller", (Ind("larger", (s / sma(s, 10) * 2.0, 1.5)), 2.5))
    return sma(close, n) + s * k * (1.0 if top else -1.0)


def divergence(n=5):
    """1 where the price fell and the strength rose over n bars, -1 the other way round, else 0."""
    p, r = change(close, n), change(rsi(close), n)
    return choose(under(p, 0.0) & over(r, 0.0), 1.0, choose(over(p, 0.0) & under(r, 0.0), -1.0, 0.0))


def volume_force():
    """Signed volume weighted by the bar's range against the ranges of 21 bars."""
    up = choose(over(typical, before(typical)), 1.0, choose(under(typical, before(typical)), -1.0, 0.0))
    return volume * ((high - low) / total(high - low, 21) - 1.0) * up * 200.0


def klinger():
    return ema(volume_force(), 34) - ema(volume_force(), 55)


def adaptive_mean(n=20, least=5, most=50, k=0.1):
    """Mean over a length that grows with the coefficient of variation."""
    size = Ind("smaller", (Ind("larger", ((sd(close, n) / sma(close, n) * k + 1.0) * float(n), float(least))), float(most)))
    return Ind("mean_of_last", (close, size), (most,))


def position_weighted(n=20):
    """Mean weighted by volume and by position, the newest bar heaviest."""
    return wma(close * volume, n) / wma(volume, n)


def rocket_rsi(n=14):
    r, boost = rsi(close, n), volume / sma(volume, n) * 0.3
    return after(n, Ind("smaller", (Ind("larger", (choose(over(r, 50.0), r + boost, r - boost), 0.0)), 100.0)), 50)


def selection_index(n=14):
    moves = change(close) / before(close)
    return after(n, (close / before(close, n) - 1.0) / Ind("root", (sma(moves * moves, n),)) * 100.0, 0)


def trend_intensity(n=20):
    up = total(choose(over(close, before(close)), 1.0, 0.0), n)
    down = total(choose(under(close, before(close)), 1.0, 0.0), n)
    return after(n, neutral_share(up, down), 50)


def know_sure_thing():
    parts = [sma(roc(close, n), m) * float(w) for n, m, w in ((10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4))]
    return after(30, parts[0] + parts[1] + parts[2] + parts[3], 0)


def rainbow(n=2, lines=10):
    """Place of the close within repeated means of means, as a percentage."""
    means = [sma(close, n)]
    for _ in range(lines - 1):
        means.append(sma(means[-1], n))
    top, bottom = Ind("larger", tuple(means)), Ind("smaller", tuple(means))
    return after(n * lines, (close - bottom) / (top - bottom) * 100.0, 0)


def random_walk(n=14):
    scale = atr(n) * math.sqrt(n)
    return after(n, Ind("larger", ((high - before(close, n)) / scale, (before(close, n) - low) / scale)), 0)


# Candles.


def top_shadow():
    return high - Ind("larger", (open_, close))


def bottom_shadow():
    return Ind("smaller", (open_, close)) - low


def hanging_man(top=0.3, bottom=1.2):
    shape = ~under(body(), (high - low) * 0.1) & ~over(top_shadow(), body() * top) & ~under(bottom_shadow(), body() * bottom)
    return shape & over(before(close, 1), before(close, 3))


def inverted_hammer():
    shape = over(top_shadow(), body() * 2.0) & under(bottom_shadow(), body() * 0.3) & under(Ind("larger", (open_, close)) - low, (high - low) * 0.6)
    return shape & under(before(close, 1), before(close, 2))


def star(morning=True):
    """A long bar, a small one beyond a gap, and a strong bar back beyond the other gap."""
    first = before(open_, 2) - before(close, 2) if morning else before(close, 2) - before(open_, 2)
    small = under(Ind("abs", (before(close) - before(open_),)), first * 0.3)
    if morning:
        gaps = under(before(high), before(close, 2)) & over(open_, before(high))
        last = close - open_
    else:
        gaps = over(before(low), before(close, 2)) & under(open_, before(low))
        last = open_ - close
    return over(first, 0.0) & small & gaps & over(last, 0.0) & over(last, first * 0.5)


def piercing():
    middle = (before(close) + before(open_)) / 2.0
    return falls(1) & rises() & under(open_, before(close)) & over(close, middle) & under(close, before(open_))


def dark_cloud():
    return rises(1) & falls() & over(open_, before(close)) & under(close, (before(close) + before(open_)) / 2.0)


def body():
    return Ind("abs", (close - open_,))


def rises(n=0):
    return over(before(close, n), before(open_, n)) if n else over(close, open_)


def falls(n=0):
    return under(before(close, n), before(open_, n)) if n else under(close, open_)


def doji(n=10, k=0.05):
    return under(body(), sma(high - low, n) * k)


def engulfing(bull=True):
    o, c = before(open_), before(close)
    return falls(1) & rises() & under(open_, c) & over(close, o) if bull else rises(1) & falls() & over(open_, c) & under(close, o)


def harami(bull=True):
    o, c = before(open_), before(close)
    return falls(1) & rises() & over(open_, c) & under(close, o) if bull else rises(1) & falls() & under(open_, c) & over(close, o)


def three_in_a_row(up=True):
    same = rises if up else falls
    moves = over(close, before(close)) & over(before(close), before(close, 2)) if up else under(close, before(close)) & under(before(close), before(close, 2))
    return same() & same(1) & same(2) & moves
