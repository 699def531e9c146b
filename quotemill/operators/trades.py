"""Trades from entry and exit signals: one ordered pass per instrument with an open position as state.

The rows of an instrument arrive sorted and are read batch by batch; only the open position is held,
so memory doesn't grow with the instrument's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Exits:
    """Percent from the entry price; None switches a rule off. `trailing` counts from the best price.

    `levels` are profit levels. A bar that reaches the next one takes a part of the profit: it gives a row
    with the reason `level_1`, `level_2` and so on, and the last level closes the position. The stop is
    `stops[0]` percent and moves on to the next with each level from the second on; without `stops` it is
    -stop_loss.
    """

    stop_loss: float | None = 5.0
    take_profit: float | None = None
    trailing: float | None = 5.0
    levels: tuple[float, ...] = ()
    stops: tuple[float, ...] = ()
    overbought: float | None = None


#: The profit levels and stops of the two forms with several levels.
MULTI_LEVEL = Exits(stop_loss=None, trailing=None, levels=(2.0, 4.0, 6.0), stops=(-1.0, -2.0, -3.0))
ADVANCED = Exits(stop_loss=None, trailing=None, levels=(1.5, 3.0, 4.5, 6.0), stops=(-0.8, -1.5, -2.5), overbought=80.0)


def _reason(exits: Exits, entry: float, best: float, price: float, signal: bool, rsi: float | None, level: int) -> tuple[str | None, int]:
    """Why the bar exits, or None, and the number of levels reached so far. The first level that the bar reaches counts."""
    gain = (price - entry) / entry * 100
    for i in range(level, len(exits.levels)):
        if gain >= exits.levels[i]:
            return f"level_{i + 1}", i + 1
    stop = -exits.stop_loss if exits.stop_loss is not None else None
    if exits.stops:
        stop = exits.stops[min(max(level - 1, 0), len(exits.stops) - 1)]
    if stop is not None and gain <= stop:
        return "stop", level
    if exits.take_profit is not None and gain >= exits.take_profit:
        return "take_profit", level
    if exits.trailing is not None and price <= best * (1 - exits.trailing / 100):
        return "trailing_stop", level
    if exits.overbought is not None and rsi is not None and rsi > exits.overbought:
        return "overbought", level
    return ("signal" if signal else None), level


def trades(signals: DataFrame, exits: Exits = Exits()) -> DataFrame:  # noqa: B008
    """(inst_id, entry_time, entry_price, exit_time, exit_price, reason, profit_percent).

    signals: inst_id, bar_time, close, entry, exit[, rsi]. A position opens at the close of an entry
    bar when none is open; later bars may close it. Bars with a null or non-positive price are passed
    over. A position that is open at the end has a row with null exit columns.
    """
    rsi = "cast(rsi as double) as rsi" if "rsi" in signals.columns else "cast(null as double) as rsi"
    rows = signals.selectExpr("inst_id", "bar_time", "cast(close as double) as close", "coalesce(entry, false) as entry", "coalesce(exit, false) as exit", rsi)
    rows = rows.where("close > 0").repartition("inst_id").sortWithinPartitions("inst_id", "bar_time")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["inst_id", "entry_time", "entry_price", "exit_time", "exit_price", "reason", "profit_percent"]
        inst, opened, entry, best, level = None, None, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for symbol, at, price, enter, leave, strength in batch.itertuples(index=False, name=None):
                if symbol != inst:
                    if opened is not None:
                        out.append((inst, opened, entry, None, None, None, None))
                    inst, opened = symbol, None
                if opened is None:
                    if enter:
                        opened, entry, best, level = at, price, price, 0
                    continue
                best = max(best, price)
                why, level = _reason(exits, entry, best, price, leave, None if strength is None or strength != strength else strength, level)
                if why:
                    out.append((inst, opened, entry, at, price, why, round((price - entry) / entry * 100, 6)))
                    if not why.startswith("level_") or level == len(exits.levels):
                        opened = None
            yield pd.DataFrame(out, columns=names)
        if opened is not None:
            yield pd.DataFrame([(inst, opened, entry, None, None, None, None)], columns=names)

    schema = "inst_id string, entry_time timestamp, entry_price double, exit_time timestamp, exit_price double, reason string, profit_percent double"
    return rows.mapInPandas(fold, schema)
