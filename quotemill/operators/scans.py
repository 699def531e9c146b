"""Recurrences over the bars of an instrument, as scans over slots of time.

A recurrence needs its own last value, so its bars can't be dealt freely. Nearly all of them are affine in
their state: over any stretch of bars the state s becomes A s + b, whatever it was before. So every slot is
summarised alone as its (A, b); the summaries of an instrument, a few numbers per slot, are applied one after the
other, which gives the state at the start of each slot; with it the slot's own values are computed. The result is that
of one pass over all bars. Sorted rows pass by in Arrow batches, so no task holds a slot either.

A kind of recurrence says how to run over arrays from a state, how to move a state over a summarised
stretch, and how two stretches are one. Bars with a null input leave the state alone and have its last value.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a slot: 400 days, 576,000 bars of a minute.
SLOT = 400 * 86400.0
State = np.ndarray | None


class Affine:
    """State: a vector. run() moves it bar by bar; `matrix` is what a bar does to it apart from the input, if that is the same for all bars."""

    matrix: np.ndarray

    def __init__(self, *params: float) -> None:
        self.params = params

    def run(self, arrays: list[np.ndarray], state: State) -> tuple[np.ndarray, np.ndarray]:
        """Values for all bars, and the state after them."""
        raise NotImplementedError

    def power(self, arrays: list[np.ndarray]) -> np.ndarray:
        return np.linalg.matrix_power(self.matrix, len(arrays[0]))

    def summary(self, arrays: list[np.ndarray]) -> np.ndarray:
        """What a stretch does: the state after it where there was none, A, and b."""
        k = self.size
        if not len(arrays[0]):
            return np.array([])
        fresh = self.run(arrays, None)[1]
        b = self.run(arrays, np.zeros(k))[1]
        return np.concatenate((fresh, self.power(arrays).ravel(), b))

    def moved(self, state: State, summary: np.ndarray) -> State:
        k = self.size
        if not len(summary):
            return state
        return summary[:k] if state is None else summary[k : k + k * k].reshape(k, k) @ state + summary[k + k * k :]

    def joined(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The summary of a stretch and the one after it."""
        if not len(one) or not len(two):
            return one if len(one) else two
        k = self.size
        both = two[k : k + k * k].reshape(k, k) @ one[k : k + k * k].reshape(k, k)
        return np.concatenate((self.moved(one[:k], two), both.ravel(), self.moved(one[k + k * k :], two)))

    def last(self, state: np.ndarray) -> np.ndarray | float:
        """The values of the bar that left this state."""
        return state[0]

    @property
    def size(self) -> int:
        return len(self.matrix)


class Mean(Affine):
    """s + weight (x - s), from the first x on. Inputs: x and a weight for each bar."""

    size = 1

    def run(self, arrays, state):
        values, weights = (a.tolist() for a in arrays)
        out, s = [], None if state is None else float(state[0])
        for x, w in zip(values, weights, strict=True):
            s = x if s is None else s + w * (x - s)
            out.append(s)
        return np.array(out), np.array(out[-1:]) if out else state

    def power(self, arrays):
        return np.array([[np.prod(1 - arrays[1])]])


def _exponential(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    if start is None:
        return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return pd.Series(np.concatenate(([start], x))).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


@dataclass(frozen=True)
class Step:
    """A step of a cascade: a mean of another step with the weight alpha, or (alpha None) a sum of means with factors."""

    sources: tuple[int, ...]
    factors: tuple[float, ...] = (1.0,)
    alpha: float | None = None


class Cascade(Affine):
    """Exponential means of one input, of each other, and of sums of them. Step 0 is the input; values: one row per step asked for."""

    def __init__(self, steps: list[Step], asked: list[int]) -> None:
        self.steps, self.asked = steps, asked
        self.means = [i for i, s in enumerate(steps) if s.alpha is not None]
        self.matrix = np.eye(len(self.means))
        unit = np.eye(len(self.means))
        self.matrix = np.stack([self.run([np.zeros(1)], unit[j])[1] for j in range(len(self.means))], axis=1)

    def run(self, arrays, state):
        values: list[np.ndarray] = [arrays[0]]
        for i, step in enumerate(self.steps[1:], 1):
            mixed = sum((values[s] * f for s, f in zip(step.sources, step.factors, strict=True)), np.zeros(len(arrays[0])))
            if step.alpha is not None:
                mixed = _exponential(mixed, step.alpha, None if state is None else state[self.means.index(i)])
            values.append(mixed)
        end = np.array([values[i][-1] for i in self.means]) if len(arrays[0]) else state
        return np.array([values[i] for i in self.asked]), end

    def last(self, state):
        values = [0.0]
        for i, step in enumerate(self.steps[1:], 1):
            values.append(state[self.means.index(i)] if step.alpha is not None else sum(values[s] * f for s, f in zip(step.sources, step.factors, strict=True)))
        return np.array([values[i] for i in self.asked])


class TwoPole(Affine):
    """p s1 + q s2 + y, of the last two values; the value is x where y is null. Inputs: x, y."""

    def __init__(self, p: float, q: float) -> None:
        self.p, self.q = p, q
        self.matrix = np.array([[p, q], [1.0, 0.0]])

    def run(self, arrays, state):
        p, q = self.p, self.q
        one, two = (0.0, 0.0) if state is None else state.tolist()
        out = []
        for x, y in zip(*(a.tolist() for a in arrays), strict=True):
            one, two = (x if y != y else p * one + q * two + y), one  # noqa: PLR0124
            out.append(one)
        return np.array(out), np.array([one, two])

    def power(self, arrays):
        if not np.isnan(arrays[1]).any():
            return super().power(arrays)
        zero = self.run(arrays, np.zeros(2))[1]
        return np.stack([self.run(arrays, e)[1] - zero for e in np.eye(2)], axis=1)


class Ladder(Affine):
    """Four stages of a Laguerre filter; the value is the share of the falls from stage to stage that rise. Input: x."""

    def __init__(self, gamma: float) -> None:
        self.gamma = gamma
        self.matrix = np.eye(4)
        self.matrix = np.stack([self.run([np.zeros(1)], e)[1] for e in np.eye(4)], axis=1)

    def run(self, arrays, state):
        g, out = self.gamma, []
        x = arrays[0].tolist()
        a, b, c, d = (x[0],) * 4 if state is None else state.tolist()
        for i, value in enumerate(x):
            if i or state is not None:  # before the second bar nothing has moved
                a0, b0, c0 = a, b, c
                a = (1 - g) * value + g * a
                b = -g * a + a0 + g * b
                c = -g * b + b0 + g * c
                d = -g * c + c0 + g * d
            out.append(self.last((a, b, c, d)))
        return np.array(out), np.array([a, b, c, d])

    def last(self, state):
        steps = [x - y for x, y in zip(state, state[1:], strict=False)]
        gain, loss = sum(max(s, 0.0) for s in steps), sum(max(-s, 0.0) for s in steps)
        return gain / (gain + loss) if gain + loss else 0.0


class Streak:
    """Length of the run of rises (positive) or of bars without one (negative). Input: 1 for a rise, -1 for none, null for no move.

    Not affine, but as simple: a stretch of one direction lengthens a run of it, any other stretch sets the length.
    """

    def run(self, arrays, state):
        s, out = 0.0 if state is None else float(state[0]), []
        for d in arrays[0].tolist():
            if d == d:  # noqa: PLR0124
                s = max(s, 0.0) + 1 if d > 0 else min(s, 0.0) - 1
            out.append(s)
        return np.array(out), np.array([s])

    def summary(self, arrays):
        moves = arrays[0][~np.isnan(arrays[0])]
        return np.array([self.run([moves], None)[1][0], float((moves == moves[0]).all())]) if len(moves) else np.array([])

    def moved(self, state, summary):
        if not len(summary):
            return state
        length, alone = summary
        s = 0.0 if state is None or not alone else float(state[0])
        return np.array([max(s, 0.0) + length if length > 0 else min(s, 0.0) + length])

    def joined(self, one, two):
        if not len(one) or not len(two):
            return one if len(one) else two
        return np.array([self.moved(one[:1], two)[0], float(one[1] and two[1] and (one[0] > 0) == (two[0] > 0))])

    def last(self, state):
        return state[0]


class Rolling:
    """A window of the last n bars. State: the values of the last n - 1 bars, one row per input.

    over(inputs, known) gives the values for the bars from `known` on; those before are there to be looked back at.
    """

    def __init__(self, n: float, *params: float) -> None:
        self.n, self.params = int(n), params

    def over(self, inputs: list[np.ndarray], known: int) -> np.ndarray:
        raise NotImplementedError

    def run(self, arrays, state):
        held = np.zeros((len(arrays), 0)) if state is None else state.reshape(len(arrays), -1)
        inputs = [np.concatenate((h, x)) for h, x in zip(held, arrays, strict=True)]
        keep = max(0, len(inputs[0]) - self.n + 1)
        return self.over(inputs, held.shape[1]), np.concatenate([x[keep:] for x in inputs])

    def summary(self, arrays):
        keep = max(0, len(arrays[0]) - self.n + 1)
        return np.concatenate([np.array([len(arrays), len(arrays[0])]), *[x[keep:] for x in arrays]]) if len(arrays[0]) else np.array([])

    def joined(self, one, two):
        if not len(one) or not len(two):
            return one if len(one) else two
        k = int(one[0])
        parts = [np.concatenate((a, b)) for a, b in zip(one[2:].reshape(k, -1), two[2:].reshape(k, -1), strict=True)]
        return np.concatenate([np.array([k, one[1] + two[1]]), *[x[max(0, len(x) - self.n + 1) :] for x in parts]])

    def moved(self, state, summary):
        if not len(summary):
            return state
        if state is None:
            return summary[2:]
        k = int(summary[0])
        parts = [np.concatenate((a, b)) for a, b in zip(state.reshape(k, -1), summary[2:].reshape(k, -1), strict=True)]
        return np.concatenate([x[max(0, len(x) - self.n + 1) :] for x in parts])

    def last(self, state):
        return np.nan  # a bar without a value has no window


def _sums(x: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the last `sizes` values before each end, by running sums from the middle of the values on."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    return total[ends] - total[ends - sizes]


class Weighted(Rolling):
    """Linearly weighted mean, the newest bar heaviest, by two running sums."""

    def over(self, inputs, known):
        x, ends = inputs[0], np.arange(known + 1, len(inputs[0]) + 1)
        sizes, middle = np.minimum(ends, self.n), float(inputs[0].mean())
        y = x - middle  # small values keep the running sums exact
        weighted = _sums(y * np.arange(len(y)), ends, sizes) - (ends - sizes - 1) * _sums(y, ends, sizes)
        return middle + weighted / (sizes * (sizes + 1) / 2)


class Ranked(Rolling):
    """The window as a sorted list, one value in and one out per bar."""

    def over(self, inputs, known):
        values, out = inputs[0].tolist(), []
        held: list[float] = []
        for i, x in enumerate(values):
            if i >= self.n:
                del held[bisect_left(held, values[i - self.n])]
            insort(held, x)
            if i >= known:
                out.append(self.value(held, x))
        return np.array(out)

    def value(self, held: list[float], x: float) -> float:
        """Nearest rank: the ceil(p * count / 100)-th smallest."""
        return held[max(0, math.ceil(self.params[0] * len(held) / 100.0) - 1)]


class RankOf(Ranked):
    """Share of the window's values that are not above the newest, as a percentage."""

    def value(self, held, x):
        return bisect_right(held, x) * 100.0 / len(held)


class Deviation(Rolling):
    """Mean distance of the window's values from their own mean, a block of windows at a time."""

    def over(self, inputs, known):
        x, out = inputs[0], []
        for i in range(known, min(self.n - 1, len(x))):
            part = x[: i + 1]
            out.append(float(np.abs(part - part.mean()).mean()))
        if len(x) >= self.n:
            windows = np.lib.stride_tricks.sliding_window_view(x, self.n)[max(0, known - self.n + 1) :]
            size = max(1, (1 << 20) // self.n)
            for at in range(0, len(windows), size):
                part = windows[at : at + size]
                out += np.abs(part - part.mean(axis=1, keepdims=True)).mean(axis=1).tolist()
        return np.array(out)


class SomeLast(Rolling):
    """Mean of as many of the last values as the second input says, rounded down, n at most."""

    def over(self, inputs, known):
        x, ends = inputs[0], np.arange(known + 1, len(inputs[0]) + 1)
        sizes, middle = np.minimum(np.minimum(np.floor(inputs[1][known:]), ends), self.n).astype(int), float(inputs[0].mean())
        sizes = np.maximum(sizes, 0)
        return np.where(sizes > 0, middle + _sums(x - middle, ends, sizes) / np.maximum(sizes, 1), np.nan)


class SinceExtreme(Rolling):
    """Bars since the newest extreme of the window, by a queue of the values that can still become it."""

    def over(self, inputs, known):
        x = inputs[0] if self.params[0] else -inputs[0]
        queue: deque[tuple[int, float]] = deque()
        out = []
        for i, v in enumerate(x.tolist()):
            while queue and queue[-1][1] <= v:
                queue.pop()
            queue.append((i, v))
            if queue[0][0] <= i - self.n:
                queue.popleft()
            if i >= known:
                out.append(float(i - queue[0][0]))
        return np.array(out)


@dataclass(frozen=True)
class Plan:
    """A recurrence over columns (or numbers): what it makes of them, under which names. loose: inputs that may be null."""

    kind: Affine | Streak | Rolling
    inputs: tuple[str | float, ...]
    columns: tuple[str, ...]
    loose: tuple[int, ...] = ()


def slot_of(order: Column, order_type: str, slot: float) -> Column:
    """The slot of a time (in seconds) or of a plain number."""
    at = F.unix_micros(order) / 1e6 if order_type == "timestamp" else F.unix_micros(order.cast("timestamp")) / 1e6 if order_type in ("date", "timestamp_ntz") else order
    return F.floor(at / slot).cast("long")


def _pieces(batches: Iterator[pa.RecordBatch], cell: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, int, int]]]]:
    """Each batch of sorted rows with its stretches of one cell: (it goes on from the batch before, start, end)."""
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in cell:
            x = batch.column(c)
            codes = pc.fill_null(pc.dictionary_encode(x).indices if not pa.types.is_integer(x.type) else x, -(1 << 31))
            codes = codes.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), n]
        first = tuple(batch.column(c)[0].as_py() for c in cell)
        yield batch, [(a == 0 and first == before, a, b) for a, b in zip(starts, starts[1:], strict=False)]
        before = tuple(batch.column(c)[n - 1].as_py() for c in cell)


def _doubles(batch: pa.RecordBatch, plans: list[Plan]) -> dict[str, np.ndarray]:
    """The plans' input columns; null is NaN."""
    used = {x for p in plans for x in p.inputs if isinstance(x, str)}
    return {x: pc.cast(batch.column(x), pa.float64()).to_numpy(zero_copy_only=False) for x in used}


def _arrays(plan: Plan, columns: dict[str, np.ndarray], a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The inputs of the bars a to b that have them, and which bars these are."""
    arrays = [columns[x][a:b] if isinstance(x, str) else np.full(b - a, float(x)) for x in plan.inputs]
    there = np.ones(b - a, bool)
    for i, x in enumerate(arrays):
        if i not in plan.loose:
            there &= ~np.isnan(x)
    return ([x[there] for x in arrays], there) if not there.all() else (arrays, there)


def _filled(plan: Plan, columns: dict[str, np.ndarray], a: int, b: int, state: State) -> tuple[np.ndarray, State]:
    """The plan's values for the bars a to b, and the state after them."""
    arrays, there = _arrays(plan, columns, a, b)
    values = np.full((len(plan.columns), b - a), np.nan)
    if state is not None:
        values[:, 0] = plan.kind.last(state)
    if there.any():
        values[:, there], state = plan.kind.run(arrays, state)
    if not there.all():
        at = np.maximum.accumulate(np.where(~np.isnan(values), np.arange(b - a), 0), axis=1)
        values = np.take_along_axis(values, at, axis=1)
    return values, state


def run_scans(df: DataFrame, plans: list[Plan], key: str, order: str, slot: float = SLOT) -> DataFrame:
    """`df` with the columns of the plans. The rows are dealt by key and slot once; the summaries and the values read that shuffle."""
    names, at = df.columns, slot_of(F.col(order), dict(df.dtypes)[order], slot)
    dealt = df.withColumn("__slot", at).withColumn("__cell", F.struct(F.col(key).alias("key"), F.col("__slot").alias("slot"))).repartition("__cell")
    kind = dict(df.dtypes)[key]
    cell = (key, "__slot")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        where: pa.RecordBatch | None = None

        def out() -> pa.RecordBatch:
            found = pa.array([[x.tolist() for x in held]], pa.list_(pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays([where.column(key), where.column("__slot"), found], ["key", "slot", "found"])

        for batch, pieces in _pieces(batches, cell):
            columns = _doubles(batch, plans)
            for goes_on, a, b in pieces:
                found = [p.kind.summary(_arrays(p, columns, a, b)[0]) for p in plans]
                if goes_on:
                    held = [p.kind.joined(x, y) for p, x, y in zip(plans, held, found, strict=True)]
                    continue
                if where is not None:
                    yield out()
                held, where = found, batch.slice(a, 1)
        if where is not None:
            yield out()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[State] = [None] * len(plans)
        for batch, pieces in _pieces(batches, ("key",)):
            out = []
            for goes_on, a, b in pieces:
                states = states if goes_on else [None] * len(plans)
                for found in batch.column("found").slice(a, b - a).to_pylist():
                    out.append([[] if s is None else s.tolist() for s in states])
                    states = [p.kind.moved(s, np.asarray(x, float)) for p, s, x in zip(plans, states, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("slot"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["key", "slot", "states"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[State] = []
        for batch, pieces in _pieces(batches, cell):
            columns = _doubles(batch, plans)
            out: list[list[np.ndarray]] = [[] for _ in plans]
            for goes_on, a, b in pieces:
                if not goes_on:
                    states = [np.asarray(s, float) if len(s) else None for s in batch.column("__states")[a].as_py()]
                for k, plan in enumerate(plans):
                    values, states[k] = _filled(plan, columns, a, b, states[k])
                    out[k].append(values)
            made = [row for values in out for row in np.concatenate(values, axis=1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x) for x in made)], [*names, *new])

    new = [c for p in plans for c in p.columns]
    summaries = dealt.sortWithinPartitions(key, "__slot", order).mapInArrow(summarise, f"key {kind}, slot long, found array<array<double>>")
    carried = summaries.repartition("key").sortWithinPartitions("key", "slot").mapInArrow(chain, f"key {kind}, slot long, states array<array<double>>")
    carried = carried.select(F.struct("key", "slot").alias("__cell"), F.col("states").alias("__states"))
    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *[(c, "double") for c in new]])
    return dealt.join(carried, "__cell").sortWithinPartitions(key, "__slot", order).mapInArrow(fill, schema)


Walk = Callable[..., tuple[tuple, float]]


def run_walks(df: DataFrame, plans: list[tuple[str, Walk, tuple[str | float, ...], tuple]], key: str, order: str) -> DataFrame:
    """`df` with a column per plan (column, step, inputs, params), for recurrences that no summary shortens.

    step(state, *values, *params) gives the next state, a tuple, and a value; the first state is (). An instrument's sorted rows pass
    by in one task, batch by batch, and only the state is held.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *[(p[0], "double") for p in plans]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, last = [()] * len(plans), [float("nan")] * len(plans)
        for batch, pieces in _pieces(batches, (key,)):
            made: list[list[float]] = [[] for _ in plans]
            for goes_on, a, b in pieces:
                if not goes_on:
                    states, last = [()] * len(plans), [float("nan")] * len(plans)
                for k, (_, step, inputs, params) in enumerate(plans):
                    columns = [pc.cast(batch.column(x).slice(a, b - a), pa.float64()).to_pylist() if isinstance(x, str) else [float(x)] * (b - a) for x in inputs]
                    state, value, out = states[k], last[k], made[k]
                    for values in zip(*columns, strict=True):
                        if all(v is not None and v == v for v in values):  # noqa: PLR0124
                            state, value = step(state, *values, *params)
                        out.append(value)
                    states[k], last[k] = state, value
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in made)], [*batch.schema.names, *(p[0] for p in plans)])

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(walk, schema)
