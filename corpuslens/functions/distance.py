"""Edit distances and subsequences of whole texts and token arrays, in Arrow batches.

Rows of the edit table are single big integers (the bit-vector form of the recurrence: one bit for each item
of the longer sequence), so a row costs a few word-parallel operations and any vocabulary will do.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def _shared_start(a: Sequence, b: Sequence) -> int:
    """Length of the common beginning, by halving (slices are compared at memory speed)."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _places(items: Sequence) -> dict:
    """For each item, an integer with a bit for every place where it stands."""
    bits: dict = {}
    for i, x in enumerate(items):
        bits.setdefault(x, []).append(i)
    out = {}
    for x, at in bits.items():
        mask = bytearray((at[-1] >> 3) + 1)
        for i in at:
            mask[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(mask, "little")
    return out


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements, each of cost 1, between two strings or lists."""
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    if end:
        a, b = a[:-end], b[:-end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    m = len(a)
    everything, last = (1 << m) - 1, 1 << (m - 1)
    where = _places(a)
    up, down, distance = everything, 0, m  # bits where the column's next value is higher or lower by one
    for x in b:
        match = where.get(x, 0)
        same = (((match & up) + up) ^ up) | match | down
        right_up, right_down = down | (everything & ~(same | up)), same & up
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up, right_down = (right_up << 1 | 1) & everything, right_down << 1 & everything
        up, down = right_down | (everything & ~(same | right_up)), same & right_up
    return distance


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of a longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    where, everything = _places(a), (1 << len(a)) - 1
    free = everything
    for x in b:
        hit = free & where.get(x, 0)
        free = ((free + hit) | (free - hit)) & everything
    return len(a) - free.bit_count()


def _rows(function, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(IntegerType())
def _edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _rows(edit_distance, a, b)


@F.arrow_udf(IntegerType())
def _common_subsequence(a: pa.Array, b: pa.Array) -> pa.Array:
    return _rows(common_subsequence, a, b)


@F.arrow_udf(StringType())
def _casefold(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.casefold() for x in text.to_pylist()], pa.string())


def distance(a: Column, b: Column) -> Column:
    """Edit distance of two strings (by code point) or of two token arrays; null if either is null."""
    return _edit_distance(a, b)


def subsequence(a: Column, b: Column) -> Column:
    """Length of a longest common subsequence of two strings or token arrays; null if either is null."""
    return _common_subsequence(a, b)


def casefold(text: Column) -> Column:
    """Full Unicode case folding."""
    return _casefold(text)
