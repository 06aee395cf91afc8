"""Whole texts as numpy arrays: words, word hashes and word shingles of an Arrow batch.

Every helper works on the byte buffers of an Arrow string array, so a batch of texts is
tokenised by a few vector operations and no Python object is made per word. Words are
``[^\\x20\\x09-\\x0D]+``; a null text has no words. Memory is about 40 bytes per byte of the
segment at hand, and segments are cut at word boundaries near ``SEGMENT_BYTES``; a text is
never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SEGMENT_BYTES = 1 << 19
BATCH_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 output function)."""
    with np.errstate(over="ignore"):
        z = x + _ODD
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64))
_SAME = np.arange(256, dtype=np.uint8)
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTE_VALUE_FOLDED = _BYTE_VALUE[_FOLDED]
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        with np.errstate(over="ignore"):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            table = np.multiply.accumulate(table)
        _powers[int(base)] = table
    return table[:n]


@dataclass
class Words:
    """Words of consecutive texts: hash of each word, and the first word of each text (with the end)."""

    hashes: np.ndarray
    offsets: np.ndarray
    #: Last two bytes of each word.
    tails: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


@contextmanager
def bounded_batches(spark, rows: int | None = None) -> Iterator[None]:
    """While open, no Arrow batch exceeds BATCH_BYTES (or one row), or that many rows; the session's settings come back after.

    Every operator that reads texts in Python runs those jobs inside.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows is not None and not 0 < int(spark.conf.get(records)) <= rows:
        wanted[records] = str(rows)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts have no bytes."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]] if len(starts) else raw[:0], starts - (starts[0] if len(starts) else 0)


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _segments(space: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut points at text starts or spaces, about SEGMENT_BYTES apart."""
    begin, n = 0, len(space)
    while begin < n:
        end = begin + SEGMENT_BYTES
        if end >= n:
            end = n
        else:
            k = int(np.searchsorted(offsets, end))
            at_text = int(offsets[k]) if k < len(offsets) else n
            gap = int(np.argmax(space[end:at_text])) if at_text > end else 0
            end = end + gap if at_text > end and space[end + gap] else at_text
        yield begin, end
        begin = end


def word_hashes(column: pa.Array, fold_case: bool = False) -> Words:
    """64-bit hashes of all words of all texts; fold_case lower-cases A-Z only."""
    raw, offsets = text_buffers(column)
    if not len(raw):
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint16))
    space = _IS_SPACE[raw]
    table = _BYTE_VALUE_FOLDED if fold_case else _BYTE_VALUE
    full = offsets[:-1][np.diff(offsets) > 0]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[full] = True
    after[full[1:] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for begin, end in _segments(space, offsets):
            i, j = np.searchsorted(starts, (begin, end))
            if i == j:
                continue
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(table[raw[begin:end]] * _power_table(_BASE, end - begin), out=sums[1:])
            s = starts[i:j] - begin
            hashes[i:j] = (sums[ends[i:j] - begin] - sums[s]) * _power_table(_BASE_INVERSE, end - begin)[s]
        hashes = mix64(hashes)
    fold = _FOLDED if fold_case else _SAME
    tails = np.where(ends - starts > 1, fold[raw[np.maximum(ends - 2, 0)]], 0).astype(np.uint16) << np.uint16(8) | fold[raw[ends - 1]]
    return Words(hashes, np.searchsorted(starts, offsets).astype(np.int64), tails)


def shingle_hashes(words: Words, size: int) -> Words:
    """Hashes of all windows of ``size`` words; a text with fewer words (but one) is one window."""
    n, counts = len(words.hashes), words.counts
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        total = np.zeros(n, np.uint64)
        for j in range(min(size, n)):
            total[: n - j] += words.hashes[j:] * factors[j]
        per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        short = np.flatnonzero((counts > 0) & (counts < size))
        for k in short:
            a, b = words.offsets[k], words.offsets[k + 1]
            total[a] = (words.hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], per_text)
    return Words(mix64(total[at]), offsets)
