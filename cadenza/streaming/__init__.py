"""Structured Streaming forms of the series detectors.

State is kept per sequence and bounded: the last step's value, the last accepted step and the steps
whose neighbourhood is not complete yet. A step's verdict needs the ``radius`` steps after it, so
results come that much later; a sequence ends when nothing arrived for it within the timeout, and
what it held is then judged with the neighbours there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _judge(held: list[tuple[int, float]], at: int, radius: int, ratio: float, floor: float) -> float | None:
    """Multiple of the median around position ``at``, or null where it is no spike."""
    around = [s for _, s in held[max(0, at - radius) : at]] + [s for _, s in held[at + 1 : at + 1 + radius]]
    base = median(around) if around else 0.0
    score = held[at][1]
    return score / (base + 1e-6) if score >= floor and score >= ratio * (base + 1e-6) else None


def spikes(stream: DataFrame, key: str = "film", step: str = "i", score: str = "score", radius: int = 15, ratio: float = 3.0, floor: float = 0.045, gap: int = 4, timeout_ms: int | None = 60_000) -> DataFrame:
    """key, i, score, spike over a stream whose steps arrive in order within each sequence; without a timeout no sequence ends."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done, last, first = pickle.loads(state.get[0]) if state.exists else ([], 0, None, None)
        ended = state.hasTimedOut
        for frame in frames:
            for i, s in sorted(zip(frame[step].tolist(), frame[score].tolist(), strict=True)):
                first = i if first is None else first
                held.append((i, s))
        found = []
        # ``done`` positions at the head are judged and stay only as neighbours
        while done < len(held) and (ended or done + radius < len(held)):
            spike = _judge(held, done, radius, ratio, floor) if held[done][0] > first else None
            if spike is not None and (last is None or held[done][0] - last >= gap):
                last = held[done][0]
                found.append((name[0], held[done][0], held[done][1], spike))
            done += 1
        drop = max(0, done - radius)
        held, done = held[drop:], done - drop
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((held, done, last, first)),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(found, columns=[key, step, score, "spike"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{step}` long, `{score}` double, spike double", "data binary", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def differences(stream: DataFrame, key: str = "film", step: str = "i", vector: str = "pixels") -> DataFrame:
    """key, i, score: mean absolute difference to the step before, carried across batches."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pickle.loads(state.get[0]) if state.exists else None
        rows = sorted(((i, list(v)) for frame in frames for i, v in zip(frame[step].tolist(), frame[vector].tolist(), strict=True)), key=lambda r: r[0])
        found = []
        for i, v in rows:
            if before is not None:
                found.append((name[0], i, sum(abs(float(x) - float(y)) for x, y in zip(v, before, strict=True)) / len(v)))
            before = v
        state.update((pickle.dumps(before),))
        yield pd.DataFrame(found, columns=[key, step, "score"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{step}` long, score double", "data binary", "append", GroupStateTimeout.NoTimeout)
