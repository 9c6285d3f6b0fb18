"""Streams of numbered chunks of signals: put in order, gaps closed after a while, each carried on from the one before."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from earshot.kernels.dynamics import Compressor

OUT = "signal_id string, chunk long, x array<double>"


class Step(Protocol):
    """What is done to a signal chunk by chunk: ``carry`` is what it needs to know of the chunks before."""

    def start(self) -> list[float]: ...

    def next(self, x: np.ndarray, carry: list[float], follows: bool) -> tuple[np.ndarray, list[float]]:
        """The chunk's output and what to carry on with; ``follows``: the chunk before it was there."""
        ...

    def end(self, carry: list[float]) -> np.ndarray:
        """What is left to give out if no chunk comes."""
        ...


class Compressing:
    """A compressor whose gain and window go on over chunks, and over gaps as if these were not there."""

    def __init__(self, rate: float, **settings: float):
        self.unit = Compressor(rate, **settings)

    def start(self) -> list[float]:
        return [1.0] + [0.0] * self.unit.window

    def next(self, x: np.ndarray, carry: list[float], follows: bool) -> tuple[np.ndarray, list[float]]:
        out, gain, tail = self.unit.run(x, carry[0], np.asarray(carry[1:]))
        return out, [gain, *tail.tolist()]

    def end(self, carry: list[float]) -> np.ndarray:
        return np.zeros(0)


class Fading:
    """Chunks that overlap their neighbours by so many samples, faded into each other in a straight line.

    The last samples of a chunk wait for the next one; where none comes they are
    given out as they are, and a chunk after a gap begins as it is.
    """

    def __init__(self, overlap: int):
        self.overlap = overlap
        self.rise = np.linspace(0, 1, overlap)

    def start(self) -> list[float]:
        return []

    def next(self, x: np.ndarray, carry: list[float], follows: bool) -> tuple[np.ndarray, list[float]]:
        waiting = np.asarray(carry)
        if follows and len(waiting):
            n = min(len(waiting), len(x))
            x = np.concatenate([waiting[:n] * (1 - self.rise[:n]) + x[:n] * self.rise[:n], x[n:]])
        elif len(waiting):
            x = np.concatenate([waiting, x])
        keep = max(len(x) - self.overlap, 0)
        return x[:keep], x[keep:].tolist()

    def end(self, carry: list[float]) -> np.ndarray:
        return np.asarray(carry)


class InOrder(StatefulProcessor):
    """Holds chunks that came before their turn; a timer gives up on one that does not come."""

    def __init__(self, step: Step, wait_ms: int, first: int):
        self.step, self.wait_ms, self.first = step, wait_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "chunk long", "x array<double>")
        self.place = handle.getValueState("place", "next long, carry array<double>, open boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, carry, _ = self._place()
        for frame in rows:
            for chunk, x in zip(frame["chunk"].tolist(), frame["x"], strict=True):
                if chunk >= at and not self.held.containsKey((chunk,)):  # else it came before, or too late
                    self.held.updateValue((chunk,), ([] if x is None else list(map(float, x)),))
        yield from self._given(key, at, carry, True, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, carry, _ = self._place()
        waiting = sorted(k[0] for k in self.held.keys())
        if waiting:
            yield from self._given(key, waiting[0], carry, False, timerValues)
        else:
            out = self.step.end(list(carry))
            self.place.update((at, self.step.start(), False))
            if len(out):
                yield self._frame([(key[0], at, out)])

    def _place(self) -> tuple[int, list[float], bool]:
        return self.place.get() if self.place.exists() else (self.first, self.step.start(), False)

    def _given(self, key: tuple, at: int, carry: list[float], follows: bool, times) -> Iterator[pd.DataFrame]:
        """The outputs of chunks from ``at`` on as far as they are there; then a timer for what is not."""
        out, carry = [], list(carry)
        while self.held.containsKey((at,)):
            made, carry = self.step.next(np.asarray(self.held.getValue((at,))[0], float), carry, follows)
            out.append((key[0], at, made))
            self.held.removeKey((at,))
            at, follows = at + 1, True
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waits = bool(list(self.held.keys())) or len(self.step.end(carry)) > 0
        if waits:
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.wait_ms)
        self.place.update((at, carry, waits))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"signal_id": [r[0] for r in rows], "chunk": [r[1] for r in rows], "x": [r[2].tolist() for r in rows]})

    def close(self) -> None:
        pass


def in_order(chunks: DataFrame, step: Step, *, wait_ms: int = 60_000, first: int = 0) -> DataFrame:
    """A stream of chunks (``signal_id``, ``chunk``, ``x``) through ``step``, each signal's in order from number ``first``.

    Chunks may come in any order, within a micro-batch and between them. A chunk
    that came twice counts once; one that has not come ``wait_ms`` after a later
    one is given up, and is left out if it comes then. What ``step`` still holds
    goes out under the next number when nothing has come for as long. Columns:
    signal_id, chunk, x. The session needs a state store for such state:
    ``spark.sql.streaming.stateStore.providerClass`` is set to RocksDB's.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = chunks.selectExpr("cast(signal_id as string) AS signal_id", "cast(chunk as long) AS chunk", "cast(x as array<double>) AS x")
    return rows.groupBy("signal_id").transformWithStateInPandas(InOrder(step, wait_ms, first), OUT, "Append", "ProcessingTime")
