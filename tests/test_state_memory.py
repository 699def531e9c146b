"""Keyed state holds a batch's ticks as numbers alone, and sends its bars on in parts."""

from __future__ import annotations

import gc
import weakref

import pandas as pd

from quotemill.streaming import state


class Cell:
    """A value or a list of the state store, in memory."""

    def __init__(self) -> None:
        self.held = None

    def exists(self) -> bool:
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value) -> None:
        self.held = value

    put = update

    def appendList(self, values) -> None:  # noqa: N802
        self.held = [*self.held, *values]


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Cell()

    getListState = getValueState

    def listTimers(self):  # noqa: N802
        return []

    def registerTimer(self, at) -> None:  # noqa: N802
        self.timer = at


def bars_of(slice_rows: int, monkeypatch) -> list[pd.DataFrame]:
    monkeypatch.setattr(state, "SLICE", slice_rows, raising=False)
    processor, alive = state.ArrivalBars(60, 5, 3, 3600), []
    processor.init(Handle())

    def batches():
        for part in range(20):
            seq = [part + 20 * k for k in range(50)]  # in no order between the batches
            frame = pd.DataFrame({"inst_id": "a", "seq": seq, "ms": [s * 20_000 for s in seq], "last": [float(s % 13) for s in seq], "volume_24h": 1.0})
            alive.append(weakref.ref(frame))
            yield frame
            del frame
            gc.collect()
            assert sum(ref() is not None for ref in alive) <= 2

    return [out for out in processor.handleInputRows(("a",), batches(), None) if len(out)]


def test_batches_are_not_kept_and_bars_go_out_in_parts(monkeypatch):
    parts = bars_of(100, monkeypatch)
    assert len(parts) == 10 and max(map(len, parts)) <= 100
    whole = bars_of(10**6, monkeypatch)
    assert len(whole) == 1 and len(whole[0]) == 333
    assert pd.concat(parts, ignore_index=True).equals(whole[0])
