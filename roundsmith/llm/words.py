"""Words of whole Arrow string columns as 64-bit hashes, without a Python object per word.

A word is a run of bytes that are no separators; separators are ASCII, so words never cut a character.
Its hash is the sum over its bytes of a random number of the byte times a power of an odd base, put
through a mixing step.  Nothing is kept from batch to batch.

Cases: null and empty strings have no words; a text of any length is hashed in slices that end at a
separator, so memory stays near ``SLICE`` bytes times 40 unless one single word is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The blank bytes, and the ASCII bytes that are no letters, digits or underscores.
BLANK = frozenset([0x20, *range(0x09, 0x0E)])
NO_WORD = frozenset(b for b in range(128) if not (chr(b).isalnum() or b == 0x5F))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """``separators``: the bytes between words; A-Z count as a-z where ``fold``."""

    def __init__(self, separators: frozenset[int] = BLANK, fold: bool = True):
        rng = np.random.default_rng(1234)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.value[ord("A"):ord("Z") + 1] = self.value[ord("a"):ord("z") + 1]
        self.gap = np.zeros(256, bool)
        self.gap[sorted(separators)] = True
        self.value[self.gap] = 0
        base = np.uint64(0xD6E8FEB86659FD93)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        self.base, self.inverse = base, inverse
        self.power, self.unpower = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, min(SLICE, 1 << 16))
            self.power, self.unpower = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))

    def _slice(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of ``raw``; a word also ends at each of ``breaks``."""
        gap = self.gap[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        breaks = breaks[(breaks > 0) & (breaks < len(raw))]
        first[breaks] = ~gap[breaks]
        starts = np.flatnonzero(first)
        if len(starts) == 0:
            return np.zeros(0, np.uint64), starts
        self._powers(len(raw))
        summed = np.add.reduceat(self.value[raw] * self.power[: len(raw)], starts)
        return mix(summed * self.unpower[starts]), starts

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, first word of each row and the number of all words)."""
        return self.placed(texts)[:2]

    def placed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``column``, and the byte of the texts' data that each word begins at."""
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        if texts.null_count:
            texts = texts.fill_null("")
            return self.placed(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at, end = int(offsets[0]), int(offsets[-1])
        hashes, starts = [], []
        while at < end:
            to = end if end - at <= SLICE else self._cut(raw, offsets, at, at + SLICE)
            breaks = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, to)] - at
            h, s = self._slice(raw[at:to], breaks)
            hashes.append(h), starts.append(s + at)
            at = to
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return flat, np.searchsorted(first, offsets).astype(np.int64), first

    def _cut(self, raw: np.ndarray, offsets: np.ndarray, at: int, to: int) -> int:
        """A place near ``to`` where no word goes on: a text's begin or a separator."""
        begin = int(offsets[np.searchsorted(offsets, to, "right") - 1])
        if begin > at:
            return begin
        blank = np.flatnonzero(self.gap[raw[at:to]])
        if len(blank):
            return at + int(blank[-1]) + 1
        stop = int(offsets[np.searchsorted(offsets, to, "right")])
        blank = np.flatnonzero(self.gap[raw[to:stop]])
        return to + int(blank[0]) if len(blank) else stop


#: What a Python worker keeps from task to task, by operator's key: the state of one operator at a time.
KEPT: dict = {}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 2 << 20, keep=None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches whose ``column`` holds about ``most_bytes`` at most (or one row).

    A worker that begins to read for an operator drops what it kept for others: all but ``keep``.
    """
    for key in [k for k in KEPT if k != keep]:
        del KEPT[key]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column)
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most_bytes, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles of ``size`` words; fewer words are one shingle."""
    n = len(hashes)
    full = np.full(max(0, n - size + 1), size, np.uint64)
    for k in range(size):
        full = mix(full * _M1 + hashes[k:k + len(full)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(full[a:b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * _M1 + hashes[k:k + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)
