"""Bounded windows over texts, and strings cut out of their bytes, without a Python step for a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weftgraph.llm.text_hash import chunks

#: Bytes of text that a task works on at a time.
WINDOW_BYTES = 4 << 20


def windows(texts: pa.Array, cuts: np.ndarray, limit: int = WINDOW_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """First row, end row, bytes, row bounds of consecutive windows, and whether the row goes on in the next one.

    Short texts share a window. A text of more than ``limit`` bytes has windows
    of its own, cut behind a byte of the class ``cuts`` (ASCII, so that no
    character is cut); only a run of ``limit`` bytes without one makes a longer window.
    """
    for begin, end, data, bounds in chunks(texts, limit):
        if end - begin > 1 or len(data) <= limit:
            yield begin, end, data, bounds, False
            continue
        at = 0
        while at < len(data):
            stop = min(at + limit, len(data))
            if stop < len(data):
                near = np.flatnonzero(cuts[data[at:stop]])
                if len(near):
                    stop = at + int(near[-1]) + 1
                else:
                    stop = next((s + int(f[0]) + 1 for s in range(stop, len(data), limit)
                                 if len(f := np.flatnonzero(cuts[data[s : s + limit]]))), len(data))
            yield begin, end, data[at:stop], np.array([0, stop - at]), stop < len(data)
            at = stop


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[data]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs given by their starts and lengths, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def cut_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The strings data[start : start + length]."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(starts, lengths)])))
    return found.cast(pa.string())
