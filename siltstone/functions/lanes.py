"""Byte-by-byte recurrences over many byte strings side by side.

A recurrence can't be cut into independent pieces, but the strings of a batch
are independent of each other: at each place one NumPy step advances all
strings that reach so far.  Strings go in groups of like length; where few are
left to advance, a plain loop ends each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Strings of a group, and how few are better served one by one.
GROUP, FEW = 1024, 12
#: Bytes of a group's table, at most.
GROUP_BYTES = 1 << 26

Steps = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def groups(datas: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, lengths) of strings of like length, longest first in each."""
    lengths = np.fromiter(map(len, datas), dtype=np.int64, count=len(datas))
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        most = max(1, int(lengths[order[at]]))
        some = order[at : at + max(1, min(GROUP, GROUP_BYTES // most))]
        # A string much shorter than the first begins a group of its own.
        some = some[lengths[some] * 2 >= most] if most > 64 else some
        yield some, lengths[some]
        at += len(some)


def columns(datas: list[bytes], numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The strings as columns of a table, one row for each place."""
    table = np.zeros((len(numbers), int(lengths[0]) if len(lengths) else 0), dtype=np.uint8)
    for k, (i, n) in enumerate(zip(numbers, lengths, strict=True)):
        table[k, :n] = np.frombuffer(datas[i], dtype=np.uint8)
    return np.ascontiguousarray(table.T)


def fold(datas: list[bytes], start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray], alone: Callable[[int, bytes], int]) -> np.ndarray:
    """The last value of ``value = step(value, byte)`` of each string; ``alone(value,
    rest)`` does the same for one string."""
    out = np.full(len(datas), start, dtype=np.uint32)
    for numbers, lengths in groups(datas):
        if len(numbers) < FEW:
            for i in numbers:
                out[i] = alone(start, datas[i])
            continue
        bytes_at = columns(datas, numbers, lengths)
        value = np.full(len(numbers), start, dtype=np.uint32)
        # How many strings reach beyond each place.
        reach = len(numbers) - np.searchsorted(lengths[::-1], np.arange(bytes_at.shape[0]), "right")
        for i in range(bytes_at.shape[0]):
            n = reach[i]
            value[:n] = step(value[:n], bytes_at[i, :n])
        out[numbers] = value
    return out
