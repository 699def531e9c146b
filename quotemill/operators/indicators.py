"""Technical indicators as a graph of named columns over bars.

An indicator is a small immutable description; `compute` turns a set of them into columns, each
shared part once. Windowed and cumulative ones become Spark window expressions over one ordering of
the instrument's bars. Recursive ones (a value that needs its own last value) are stated by a few recurrences
over such columns and run as scans over slots of time (scans.py), so that one busy instrument is spread over
tasks, no group is unbounded and the values are those of one pass. A bar with a null input leaves a recurrence's state alone and
has its last value.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quotemill.operators import scans

#: Windows of up to this many bars are lists in a window expression where an operation needs their values; longer ones pass by as scans.
LISTED = 64
#: Values whose difference is within this share of them, or of 1, are equal: sums of the same numbers in another order differ by less.
EQUAL = 1e-9


@dataclass(frozen=True)
class Ind:
    """op applied to inputs (other indicators or numbers) with whole or decimal parameters."""

    op: str
    inputs: tuple[Ind | float, ...] = ()
    params: tuple[float, ...] = ()

    @property
    def column(self) -> str:
        return self.op if self.op in INPUTS else "i_" + hashlib.md5(repr(self).encode()).hexdigest()[:16]  # noqa: S324

    def _with(self, op: str, other: Ind | float) -> Ind:
        return Ind(op, (self, other))

    def __add__(self, other):
        return self._with("add", other)

    def __sub__(self, other):
        return self._with("sub", other)

    def __mul__(self, other):
        return self._with("mul", other)

    def __truediv__(self, other):
        return self._with("div", other)

    def __and__(self, other):
        return self._with("and", other)

    def __or__(self, other):
        return self._with("or", other)

    def __invert__(self):
        return Ind("not", (self,))


INPUTS = ("open", "high", "low", "close", "volume")
open_, high, low, close, volume = (Ind(x) for x in INPUTS)

Frame = Callable[[int], WindowSpec]
_EXPRESSIONS: dict[str, Callable[..., Column]] = {}
#: Indicators stated by others: a graph instead of the node.
_RECURSIONS: dict[str, Callable[..., Ind]] = {}
#: Recurrences that pass by bar by bar: step(state, *values, *params) gives the next state and a value.
_WALKS: dict[str, scans.Walk] = {}


def _expression(f: Callable[..., Column]) -> Callable[..., Column]:
    """Registers a column expression: f(run, rows, *inputs, *params)."""
    _EXPRESSIONS[f.__name__.strip("_")] = f
    return f


def _recursion(f: Callable[..., Ind]) -> Callable[..., Ind]:
    """Registers an indicator as a graph of others: f(*inputs, *params)."""
    _RECURSIONS[f.__name__.strip("_")] = f
    return f


def register_indicator(name: str, function: Callable, recursive: bool = False) -> Callable[..., Ind]:
    """Add an indicator of one's own; returns its constructor (inputs first, parameters by keyword order).

    function: (run, rows, *inputs, *params) gives a column; recursive: (state, *values, *params) gives the next
    state, a tuple, and a value, bar by bar from the state () on.
    """
    if name in _EXPRESSIONS or name in _WALKS or name in _RECURSIONS or name in _SCANS or name in _MEANS:
        raise ValueError(f"{name} is taken")
    (_WALKS if recursive else _EXPRESSIONS)[name] = function
    return lambda *inputs, **params: Ind(name, inputs, tuple(params.values()))


# Column expressions.


@_expression
def add(run, rows, a, b):
    return a + b


@_expression
def sub(run, rows, a, b):
    return a - b


@_expression
def mul(run, rows, a, b):
    return a * b


@_expression
def div(run, rows, a, b):
    """0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


@_expression
def and_(run, rows, a, b):
    return a & b


@_expression
def or_(run, rows, a, b):
    return a | b


@_expression
def not_(run, rows, a):
    return ~a


@_expression
def abs_(run, rows, a):
    return F.abs(a)


@_expression
def larger(run, rows, *a):
    return F.greatest(*a)


@_expression
def smaller(run, rows, *a):
    return F.least(*a)


def _exceeds(a, b):
    return a - b > F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * EQUAL


@_expression
def over(run, rows, a, b):
    return F.coalesce(_exceeds(a, b), F.lit(False))


@_expression
def under(run, rows, a, b):
    return F.coalesce(_exceeds(b, a), F.lit(False))


@_expression
def sign(run, rows, a, b):
    """The side on which a stands of b: 1, -1, or null where they are equal."""
    return F.when(_exceeds(a, b), 1).when(_exceeds(b, a), -1)


@_expression
def crossed(run, rows, side, to):
    """The side is `to` now, and the last earlier bar that took a side took the other."""
    before = F.last(side, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce((side == to) & (before == -to), F.lit(False))


@_expression
def at_least(run, rows, *args):
    """At least k of the rules hold; the last argument is k."""
    *rules, k = args
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int")) >= k


@_expression
def lag(run, rows, a, n):
    return F.lag(a, int(n)).over(run)


@_expression
def lag_or_self(run, rows, a, n):
    """The value n bars ago; the first bar's own neighbour rule: the value itself where there is none."""
    return F.coalesce(F.lag(a, int(n)).over(run), a)


@_expression
def sma(run, rows, a, n):
    return F.avg(a).over(rows(n))


@_expression
def total(run, rows, a, n):
    return F.sum(a).over(rows(n))


@_expression
def sd(run, rows, a, n):
    return F.stddev_pop(a).over(rows(n))


@_expression
def variance(run, rows, a, n):
    return F.var_pop(a).over(rows(n))


@_expression
def skewness(run, rows, a, n):
    return F.coalesce(F.skewness(a).over(rows(n)), F.lit(0.0))


@_expression
def kurtosis(run, rows, a, n):
    return F.coalesce(F.kurtosis(a).over(rows(n)), F.lit(0.0))


@_expression
def highest(run, rows, a, n):
    return F.max(a).over(rows(n))


@_expression
def lowest(run, rows, a, n):
    return F.min(a).over(rows(n))


@_expression
def wma(run, rows, a, n):
    """Linearly weighted mean, the newest bar heaviest."""
    values = F.collect_list(a).over(rows(n))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    step = lambda acc, x: F.struct((acc["s"] + x * (acc["k"] + 1)).alias("s"), (acc["k"] + 1).alias("k"))
    return F.aggregate(values, start, step, lambda acc: acc["s"] / (acc["k"] * (acc["k"] + 1) / 2))


@_expression
def cumulative(run, rows, a):
    return F.sum(a).over(run.rowsBetween(W.unboundedPreceding, 0))


@_expression
def compounded(run, rows, a, start):
    """start times the product of (1 + a) so far; a must stay above -1."""
    return F.lit(start) * F.exp(F.sum(F.log1p(a)).over(run.rowsBetween(W.unboundedPreceding, 0)))


@_expression
def percentile(run, rows, a, n, p):
    """Nearest rank: the ceil(p * count / 100)-th smallest."""
    values = F.array_sort(F.collect_list(a).over(rows(n)))
    return F.get(values, F.greatest(F.ceil(p * F.size(values) / 100.0).cast("int") - 1, F.lit(0)))


@_expression
def percent_rank(run, rows, a, n):
    """Share of the last n values that are not above this one, as a percentage."""
    values = F.collect_list(a).over(rows(n))
    return F.size(F.filter(values, lambda x: x <= a)) * 100.0 / F.size(values)


@_expression
def bar_number(run, rows):
    return F.row_number().over(run).cast("double")


@_expression
def slope(run, rows, a, t, n):
    return F.coalesce(F.regr_slope(a, t).over(rows(n)), F.lit(0.0))


@_expression
def trend_value(run, rows, a, t, n, ahead):
    """The regression line `ahead` bars beyond the last one."""
    w = rows(n)
    return F.coalesce(F.regr_intercept(a, t).over(w) + F.regr_slope(a, t).over(w) * (t + ahead), a)


@_expression
def r_squared(run, rows, a, t, n):
    return F.coalesce(F.regr_r2(a, t).over(rows(n)), F.lit(0.0))


@_expression
def correlation(run, rows, a, b, n):
    return F.coalesce(F.corr(a, b).over(rows(n)), F.lit(0.0))


@_expression
def mean_deviation(run, rows, a, n):
    """Mean distance of the last n values from their own mean."""
    w = rows(n)
    values, middle = F.collect_list(a).over(w), F.avg(a).over(w)
    return F.aggregate(F.transform(values, lambda x: F.abs(x - middle)), F.lit(0.0), lambda s, x: s + x) / F.size(values)


@_expression
def mean_of_last(run, rows, a, size, most):
    """Mean of as many of the last values as `size` says, rounded down, `most` at most."""
    values = F.collect_list(a).over(rows(most))
    n = F.least(F.floor(size).cast("int"), F.size(values))
    return F.aggregate(F.slice(values, F.size(values) - n + 1, n), F.lit(0.0), lambda s, x: s + x) / n


@_expression
def arctan(run, rows, a):
    return F.degrees(F.atan(a))


@_expression
def log_(run, rows, a):
    return F.when(a > 0, F.ln(a)).otherwise(F.lit(0.0))


@_expression
def root(run, rows, a):
    return F.sqrt(F.greatest(a, F.lit(0.0)))


@_expression
def choose(run, rows, condition, yes, no):
    return F.when(condition, yes).otherwise(no)


@_expression
def since_extreme(run, rows, a, n, top):
    """Bars since the newest extreme of the last n bars."""
    values = F.collect_list(a).over(rows(n))
    best = F.array_max(values) if top else F.array_min(values)
    return (F.array_position(F.reverse(values), best) - 1).cast("double")


@_expression
def lag_or_first(run, rows, a, n):
    """The value n bars ago; where there is none, the first bar's."""
    return F.coalesce(F.lag(a, int(n)).over(run), F.first(a).over(run.rowsBetween(W.unboundedPreceding, 0)))


@_expression
def mix(run, rows, a, *weights):
    """Weighted sum of the value and those before it; null until all are there."""
    return sum((F.lag(a, k).over(run) * w for k, w in enumerate(weights[1:], 1)), a * weights[0])


@_expression
def mix_or_self(run, rows, a, *weights):
    return F.coalesce(mix(run, rows, a, *weights), a)


@_expression
def direction(run, rows, a):
    """1 for a rise, -1 for none, null at the first bar."""
    was = F.lag(a).over(run)
    return F.when(a > was, 1.0).when(was.isNotNull(), -1.0)


@_expression
def slope_of_seven(run, rows, a):
    """The regression slope of the last seven bars, 0 until eight are there."""
    steep = sum((F.lag(a, k).over(run) * (3 - k) for k in range(1, 7)), a * 3) / 28
    return F.when(F.lag(a, 7).over(run).isNotNull(), steep).otherwise(0.0)


@_expression
def fractal_weight(run, rows, h, lo, n):
    """The weight that the fractal dimension of the last n bars gives; 1 for the first n bars."""
    half = int(n) // 2
    span = lambda w: F.max(h).over(w) - F.min(lo).over(w)
    parts = (span(run.rowsBetween(1 - 2 * half, -half)) + span(rows(half))) / half / (span(rows(n)) / n + 1e-300)
    size = F.least(F.greatest(F.log2(parts), F.lit(1.0)), F.lit(2.0))
    weight = F.least(F.greatest(F.exp((size - 1) * -4.6), F.lit(0.01)), F.lit(1.0))
    return F.when(F.row_number().over(run) <= n, 1.0).when(parts > 0, weight).otherwise(0.0)


# Recursive indicators as graphs.


@_recursion
def zlema(x, n):
    """Moves to the value projected by the change over half the length."""
    return Ind("ema", (x * 2.0 - Ind("lag_or_first", (x,), ((n - 1) // 2,)),), (n,))


@_recursion
def kama(x, n, fast, slow):
    """Smoothing follows the efficiency of the last n moves."""
    noise = Ind("total", (Ind("abs", (x - Ind("lag_or_self", (x,), (1,)),)),), (n,))
    efficiency = Ind("abs", (x - Ind("lag_or_first", (x,), (n,)),)) / noise
    weight = efficiency * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)
    return Ind("mean", (x, weight * weight))


@_recursion
def streak(x):
    """Length of the run of rises (positive) or of the run of bars without one (negative)."""
    return Ind("streak_of", (Ind("direction", (x,)),))


@_recursion
def cyber_cycle(x, alpha):
    smooth = Ind("mix_or_self", (x,), (1 / 6, 2 / 6, 2 / 6, 1 / 6))
    k = (1 - alpha / 2) ** 2
    return Ind("pair", (0.0, Ind("mix", (smooth,), (k, -2 * k, k))), (2 * (1 - alpha), -((1 - alpha) ** 2)))


@_recursion
def two_pole(x, n):
    """Two-pole Butterworth low-pass filter of period n."""
    a = math.exp(-math.sqrt(2) * math.pi / n)
    b = 2 * a * math.cos(math.sqrt(2) * math.pi / n)
    c = (1 - b + a * a) / 4
    return Ind("pair", (x, Ind("mix", (x,), (c, 2 * c, c))), (b, -a * a))


@_recursion
def super_smoother(x, n):
    """Two-pole filter of the mean of neighbouring values."""
    a = math.exp(-1.414 * math.pi / n)
    b = 2 * a * math.cos(1.414 * math.pi / n)
    c = (1 - b + a * a) / 2
    return Ind("pair", (x, Ind("mix", (x,), (c, c, 0.0))), (b, -a * a))


@_recursion
def gaussian(x, n, poles):
    """The value itself for n bars; then each pole mixes in the value of the bar before, which makes one mean of the weight alpha ** poles."""
    beta = (1 - math.cos(2 * math.pi / n)) / (2 ** (1 / poles) - 1)
    alpha = min(-beta + math.sqrt(beta * beta + 2 * beta), 1.0)
    return Ind("mean", (x, Ind("choose", (Ind("over", (Ind("bar_number"), n + 0.5)), alpha**poles, 1.0))))


@_recursion
def one_pole_slope(x, n, most):
    """Exponential mean moved on towards the value by the slope of the last seven bars.

    The correction is not fed back into the mean: fed back, a steep price makes it run away.
    """
    mean = Ind("ema", (x,), (n,))
    return mean + Ind("smaller", (Ind("abs", (Ind("slope_of_seven", (x,)),)) * (n / 4), float(most))) * (x - mean)


@_recursion
def fractal_mean(x, h, lo, n):
    """Exponential mean whose weight follows the fractal dimension of the last n bars."""
    return Ind("mean", (x, Ind("fractal_weight", (h, lo), (n,))))


#: Recurrences over ready columns: the kind for the parameters, and the inputs that may be null.
_SCANS: dict[str, tuple[Callable[..., scans.Affine | scans.Streak], tuple[int, ...]]] = {
    "mean": (scans.Mean, ()),
    "pair": (scans.TwoPole, (1,)),
    "laguerre_rsi": (scans.Ladder, ()),
    "streak_of": (scans.Streak, (0,)),
}
#: Windows whose values an operation needs: the kind for the length and the further parameters.
_ROLLING: dict[str, Callable[..., scans.Rolling]] = {
    "wma": scans.Weighted,
    "percentile": scans.Ranked,
    "percent_rank": scans.RankOf,
    "mean_deviation": scans.Deviation,
    "mean_of_last": scans.SomeLast,
    "since_extreme": scans.SinceExtreme,
}
#: Exponential means: the weight of a new value for the parameter. Means of one input, of each other and of sums of them run together.
_MEANS: dict[str, Callable[[float], float]] = {"ema": lambda n: 2 / (n + 1), "wilder": lambda n: 1 / n, "ema_alpha": float}


def sar(state: tuple, h: float, lo: float, step: float, most: float) -> tuple[tuple, float]:
    """Parabolic stop and reverse. state: rising, stop, extreme, speed, and the last two bars' highs and lows."""
    if not state:
        return (True, lo, h, step, h, h, lo, lo), lo
    up, stop, extreme, speed, h1, h2, l1, l2 = state
    stop += speed * (extreme - stop)
    if up:
        stop = min(stop, l1, l2)
        if lo < stop:
            up, stop, extreme, speed = False, extreme, lo, step
        elif h > extreme:
            extreme, speed = h, min(speed + step, most)
    else:
        stop = max(stop, h1, h2)
        if h > stop:
            up, stop, extreme, speed = True, extreme, h, step
        elif lo < extreme:
            extreme, speed = lo, min(speed + step, most)
    return (up, stop, extreme, speed, h, h1, lo, l1), stop


_WALKS["sar"] = sar


def _stated(nodes: Iterable[Ind]) -> dict[Ind, Ind]:
    """Every node with its recursions replaced by their graphs."""
    made: dict[Ind, Ind] = {}

    def visit(node: Ind) -> Ind:
        if node not in made:
            inputs = tuple(visit(x) if isinstance(x, Ind) else x for x in node.inputs)
            if node.op in _RECURSIONS:
                made[node] = visit(_RECURSIONS[node.op](*inputs, *node.params))
            else:
                made[node] = Ind(node.op, inputs, node.params)
        return made[node]

    for node in nodes:
        visit(node)
    return made


def _depends(nodes: Iterable[Ind]) -> dict[Ind, int]:
    """Every node and the stage in which it can be computed."""
    stage: dict[Ind, int] = {}

    def visit(node: Ind) -> int:
        if node not in stage:
            below = [visit(x) for x in node.inputs if isinstance(x, Ind)]
            stage[node] = 0 if node.op in INPUTS else 1 + max(below, default=0)
        return stage[node]

    for node in nodes:
        visit(node)
    return stage


def _cascades(waiting: list[Ind], ready: set[Ind]) -> tuple[list[scans.Plan], list[Ind]]:
    """All means that can run together with others of the same ready input: the plans, and the nodes that they make."""
    steps: dict[Ind, list[scans.Step]] = {}
    member: dict[Ind, tuple[Ind, int]] = {}  # node: its cascade's input, and its step there

    def join(node: Ind, root: Ind, step: scans.Step) -> None:
        steps.setdefault(root, [scans.Step(())]).append(step)
        member[node] = (root, len(steps[root]) - 1)

    for node in waiting:  # inputs come first
        first, *others = [*node.inputs, None]
        if node.op in _MEANS:
            weight = _MEANS[node.op](*node.params)
            if first in ready:
                join(node, first, scans.Step((0,), (1.0,), weight))
            elif first in member:
                root, at = member[first]
                join(node, root, scans.Step((at,), (1.0,), weight))
        elif node.op in ("add", "sub") and first in member and others[0] in member and member[first][0] == member[others[0]][0]:
            root, at = member[first]
            join(node, root, scans.Step((at, member[others[0]][1]), (1.0, 1.0 if node.op == "add" else -1.0)))
        elif node.op == "mul" and first in member and not isinstance(others[0], Ind):
            root, at = member[first]
            join(node, root, scans.Step((at,), (float(others[0]),)))
    plans, made = [], []
    for root, chain in steps.items():
        means = [(n, at) for n, (r, at) in member.items() if r == root and n.op in _MEANS]
        if means:
            plans.append(scans.Plan(scans.Cascade(chain, [at for _, at in means]), (root.column,), tuple(n.column for n, _ in means)))
            made += [n for n, _ in means]
    return plans, made


def compute(bars: DataFrame, wanted: dict[str, Ind], key: str = "inst_id", order: str = "bar_time", slot: float = scans.SLOT, listed: int = LISTED) -> DataFrame:
    """`bars` with one column per wanted indicator. Windows are partial at the start of an instrument.

    slot: seconds (or units of a numeric order) that recurrences are cut into; listed: the longest window that is a list.
    Values depend on neither.
    """
    run = W.partitionBy(key).orderBy(order)
    rows: Frame = lambda n: run.rowsBetween(1 - int(n), 0)
    names = bars.columns
    stated = _stated(wanted.values())
    out = bars.withColumns({c: F.col(c).cast("double") for c in INPUTS if c in names})
    stage = _depends(stated[n] for n in wanted.values())
    ready = {n for n, s in stage.items() if s == 0}
    waiting = sorted((n for n in stage if n not in ready), key=lambda n: (stage[n], n.column))
    value = lambda x: F.col(x.column) if isinstance(x, Ind) else F.lit(float(x))
    name = lambda x: x.column if isinstance(x, Ind) else float(x)
    while waiting:
        open_to = lambda n: all(x in ready for x in n.inputs if isinstance(x, Ind))  # noqa: E731, B023
        rolled = lambda n: n.op in _ROLLING and n.params[0] > listed
        able = [n for n in waiting if n.op in _EXPRESSIONS and not rolled(n) and open_to(n)]
        if able:
            out = out.withColumns({n.column: _EXPRESSIONS[n.op](run, rows, *map(value, n.inputs), *n.params) for n in able})
        else:
            plans, able = _cascades(waiting, ready)
            for n in waiting:
                if n.op in _SCANS and open_to(n):
                    kind, loose = _SCANS[n.op]
                    plans.append(scans.Plan(kind(*n.params), tuple(map(name, n.inputs)), (n.column,), loose))
                    able.append(n)
                elif rolled(n) and open_to(n):
                    plans.append(scans.Plan(_ROLLING[n.op](*n.params), tuple(map(name, n.inputs)), (n.column,)))
                    able.append(n)
            walks = [n for n in waiting if n.op in _WALKS and open_to(n)]
            if plans:
                out = scans.run_scans(out, plans, key, order, slot)
            if walks:
                out = scans.run_walks(out, [(n.column, _WALKS[n.op], tuple(map(name, n.inputs)), n.params) for n in walks], key, order)
            able += walks
            if not able:
                raise ValueError(f"unknown indicator {waiting[0].op}")
        ready.update(able)
        waiting = [n for n in waiting if n not in ready]
    return out.select(*names, *[F.col(stated[n].column).alias(label) for label, n in wanted.items()])
