"""Indicators that SQL can call as a table function.

    SELECT * FROM indicator(TABLE(bars), 'RSI', map('period', '14'))

The function deals its table by inst_id and orders it by bar_time itself. An instrument's bars pass by row by row in one
task and only the state of the indicator is held, so it serves SQL users; `operators.indicators` computes many
indicators at once and spreads an instrument over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, Row, StringType, StructField, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

SCHEMA = StructType([StructField("inst_id", StringType()), StructField("bar_time", TimestampType()), StructField("value", DoubleType())])
Step = Callable[[Row], float]


def _window(n: int, of: Callable[[Row], float], fold: Callable[[deque], float]) -> Step:
    held: deque[float] = deque(maxlen=n)

    def step(bar: Row) -> float:
        held.append(of(bar))
        return fold(held)

    return step


def _mean(weight: float) -> Callable[[float], float]:
    state: list[float] = []

    def step(x: float) -> float:
        state[:] = [state[0] + weight * (x - state[0]) if state else x]
        return state[0]

    return step


def _rsi(n: int) -> Step:
    before: list[float] = []
    gain, loss = _mean(1 / n), _mean(1 / n)

    def step(bar: Row) -> float:
        change = bar.close - before[0] if before else 0.0
        before[:] = [bar.close]
        up, down = gain(max(change, 0.0)), loss(max(-change, 0.0))
        return up / (up + down) * 100 if up + down else 0.0

    return step


def _atr(n: int) -> Step:
    before: list[float] = []
    mean = _mean(1 / n)

    def step(bar: Row) -> float:
        last = before[0] if before else bar.close
        before[:] = [bar.close]
        return mean(max(bar.high - bar.low, abs(bar.high - last), abs(bar.low - last)))

    return step


def _macd(short: int, long: int) -> Step:
    fast, slow = _mean(2 / (short + 1)), _mean(2 / (long + 1))
    return lambda bar: fast(bar.close) - slow(bar.close)


#: Names, lengths and their defaults.
STEPS: dict[str, tuple[dict[str, int], Callable[..., Step]]] = {
    "SMA": ({"period": 20}, lambda period: _window(period, lambda b: b.close, lambda h: sum(h) / len(h))),
    "HIGHEST": ({"period": 15}, lambda period: _window(period, lambda b: b.high, max)),
    "LOWEST": ({"period": 15}, lambda period: _window(period, lambda b: b.low, min)),
    "EMA": ({"period": 12}, lambda period: (lambda mean: lambda b: mean(b.close))(_mean(2 / (period + 1)))),
    "RSI": ({"period": 14}, _rsi),
    "ATR": ({"period": 14}, _atr),
    "MACD": ({"short_period": 12, "long_period": 26}, _macd),
}


def step_of(name: str, params: dict[str, str] | None) -> Step:
    """The indicator as a function of one bar after the other; ValueError for a name that isn't known or a length that isn't one."""
    if name is None or name.upper() not in STEPS:
        raise ValueError(f"unknown indicator {name}; known: {', '.join(STEPS)}")
    defaults, make = STEPS[name.upper()]
    lengths = {k: int((params or {}).get(k, v)) for k, v in defaults.items()}
    if min(lengths.values()) < 1:
        raise ValueError(f"a length of {name} is below 1")
    return make(*lengths.values())


class Indicator:
    """indicator(TABLE(bars), name [, params]): inst_id, bar_time and value per bar. A bar with a null price leaves the state alone and has the last value."""

    @staticmethod
    def analyze(bars: AnalyzeArgument, name: AnalyzeArgument, params: AnalyzeArgument | None = None) -> AnalyzeResult:
        missing = {"inst_id", "bar_time", "close", "high", "low"} - set(bars.dataType.fieldNames() if bars.isTable else ())
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        step_of(name.value, params.value if params is not None and params.isConstantExpression else None)
        return AnalyzeResult(SCHEMA, partitionBy=[PartitioningColumn("inst_id")], orderBy=[OrderingColumn("bar_time")])

    def __init__(self) -> None:
        self.step: Step | None = None
        self.last: float | None = None

    def eval(self, bar: Row, name: str, params: dict[str, str] | None = None) -> Iterator[tuple]:
        if self.step is None:
            self.step = step_of(name, params)
        if None not in (bar.close, bar.high, bar.low):
            self.last = self.step(bar)
        yield bar.inst_id, bar.bar_time, self.last


def register(spark: SparkSession, name: str = "indicator") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, udtf(Indicator))
