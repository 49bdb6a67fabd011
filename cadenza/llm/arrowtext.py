"""Arrow batches of texts: bounded slices, and words as dictionary codes.

Splitting and dictionary encoding run in Arrow's C++ kernels, so Python sees each distinct word of
a slice once, however often it occurs.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 4 << 20


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """This process's one model: a worker that serves a later stage gives the earlier one's memory back first."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what an earlier stage's model holds in this process; for stages that need none."""
    held("", lambda: None)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                ends.append(i)
                start, total = i, 0
            total += n
        start = 0
        for end in [*ends, batch.num_rows]:
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column as large strings in a buffer of their own, null as empty.

    The copy matters: Arrow's ascii_lower misplaces strings whose buffer does not begin with them.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def encode_words(words: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes of all words in order, offsets of the texts, the distinct words)."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], flat.dictionary.to_pylist()


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column without nulls, offsets), without copying."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], zero for empty segments."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
