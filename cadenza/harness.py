"""Timing and concurrency around actions; nothing here touches rows."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame


class Timer:
    """Seconds of a block in ``elapsed``."""

    elapsed = 0.0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.elapsed = time.perf_counter() - self._began


def run_all(frame: DataFrame) -> float:
    """Seconds to compute every row of a frame and keep none."""
    with Timer() as timer:
        frame.write.format("noop").mode("overwrite").save()
    return timer.elapsed


def run_together(makers: Sequence[Callable[[], DataFrame]]) -> tuple[float, list[float]]:
    """(wall seconds, seconds of each) of jobs that one session runs at the same time."""
    with Timer() as timer, ThreadPoolExecutor(max(1, len(makers))) as pool:
        each = list(pool.map(lambda make: run_all(make()), makers))
    return timer.elapsed, each


def provenance(folder: str) -> tuple[str | None, bool | None]:
    """(commit, whether files differ from it) of a git folder; both null, never made up, where git or its data lack."""
    try:
        ask = lambda *words: subprocess.run(["git", *words], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
        return ask("rev-parse", "HEAD"), bool(ask("status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError):
        return None, None
