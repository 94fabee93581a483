"""Words and their 64-bit hashes, for a whole Arrow batch of texts at once.

All functions work on the UTF-8 bytes of many texts laid end to end, so a task
needs no Python step for a word or a character. Two words with equal bytes have
equal hashes in every task; different words collide with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93
_GRAM_INV = pow(_GRAM, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        table[65:91] = table[97:123]
    return table


_EXACT, _FOLDED = _byte_table(False), _byte_table(True)


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to a word."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Everything but space, tab, line ends, vertical tab and form feed.
NOT_SPACE = byte_class((0, 8), (14, 31), (33, 255))
#: Digits, ASCII letters, and every byte of a character outside ASCII.
LETTERS = byte_class((48, 57), (65, 90), (97, 122), (128, 255))


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2^64; short runs are kept for the task."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < count:
        kept = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if count <= 2 * CHUNK_BYTES:
            _POWERS[base] = kept
    return kept[:count]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes: first row, end row, bytes, row bounds.

    A null text is empty. A text is never cut: a longer one is a chunk by itself.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        bounds = offsets[row : end + 1] - offsets[row]
        yield row, end, whole[offsets[row] : offsets[end]], bounds
        row = end


class Words:
    """The words of the texts of one chunk.

    start, end: byte places; first: each text's first word (one more entry than
    texts); row: each word's text; hash: of the bytes, A-Z lower-cased if asked.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray, fold: bool = True):
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = table[data]
        fresh, last = inside.copy(), inside.copy()
        fresh[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        opening = bounds[:-1][bounds[:-1] < n]
        closing = bounds[1:][bounds[1:] > 0] - 1
        fresh[opening] = inside[opening]
        last[closing] = inside[closing]
        self.start = np.flatnonzero(fresh)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.counts)
        terms = (_FOLDED if fold else _EXACT)[data] * _power(_BASE, n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, dtype=np.uint64, out=total[1:])
        width = (self.end - self.start).astype(np.uint64)
        inverse = _power(_BASE_INV, n + 1)[self.start]
        self.hash = mix((total[self.end] - total[self.start]) * inverse + width)

    @classmethod
    def of_hashes(cls, texts: list[np.ndarray]) -> Words:
        """Texts given by their words' hashes; without bytes and places."""
        out = cls.__new__(cls)
        out.counts = np.array([len(t) for t in texts], dtype=np.int64)
        out.first = np.concatenate([[0], np.cumsum(out.counts)])
        out.row = np.repeat(np.arange(len(texts)), out.counts)
        out.hash = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        return out

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and where a text has that many."""
        n = len(self.hash)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * _power(_GRAM, max(n, 1))[:n], dtype=np.uint64, out=total[1:])
        begin = np.arange(n)
        stop = np.minimum(begin + size, n)
        hashes = mix((total[stop] - total[begin]) * _power(_GRAM_INV, max(n, 1))[:n] + np.uint64(size))
        return hashes, begin + size <= self.first[1:][self.row]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct ``size``-word shingles, sorted by both.

        A text with fewer words is one shingle of all its words; without words it has none.
        """
        hashes, whole = self.windows(size)
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        rows, values = self.row[whole], hashes[whole]
        if len(short):
            extra = []
            for r in short:
                words = self.hash[self.first[r] : self.first[r + 1]]
                value = np.uint64(len(words))
                for j, w in enumerate(words.tolist()):
                    value = np.uint64((int(value) + w * pow(_GRAM, j, 1 << 64)) & _MASK)
                extra.append(value)
            rows = np.concatenate([rows, short])
            values = np.concatenate([values, mix(np.array(extra, dtype=np.uint64))])
        by_value = np.argsort(values)
        rows, values = rows[by_value], values[by_value]
        by_row = np.argsort(rows.astype(np.uint16) if len(self.counts) <= 65536 else rows, kind="stable")
        rows, values = rows[by_row], values[by_row]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        return rows[fresh], values[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
