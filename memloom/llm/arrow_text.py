"""Vectorised helpers over Arrow string columns, used inside tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; bounds the memory of a task, whatever the length of a text.
BLOCK = 1 << 20


def tidy(run):
    """``run`` for mapInArrow, after which the worker gives unused memory back to the system.

    Workers live on between tasks and share an executor's memory with the JVM.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, or a single longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = end


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s:s + n]`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def distinct_fragments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Split ``data`` at ``starts`` (rising, first 0): the code of each fragment and the distinct fragments."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


#: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of each row start: word start positions, their row, and whether a word starts at each byte.

    A word is a longest run of bytes outside ASCII white space; rows end words.
    """
    solid = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    if len(data):
        first[1:] = solid[1:] & ~solid[:-1]
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[inside] = solid[inside]
    at = np.flatnonzero(first)
    return at, np.searchsorted(offsets, at, side="right") - 1, first


_in_use: list = []


def hold_alone(cache) -> None:
    """Let ``cache`` be the only one that this worker holds: workers live on from stage to stage, and so would the caches of all."""
    if not _in_use or _in_use[0] is not cache:
        for other in _in_use:
            other.forget()
        _in_use[:] = [cache]


class WordValues:
    """Per-word values that are computed once for each distinct word and kept for the next batches.

    ``compute(word)`` gives the value of a word (bytes). At most ``most`` words are kept.
    """

    def __init__(self, compute, most: int = 100_000):
        self.compute, self.most, self.known = compute, most, {}

    def forget(self) -> None:
        self.known.clear()

    def of(self, data: np.ndarray, offsets: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
        """The value of each word in order, and the row of each."""
        at, rows, _ = words(data, offsets)
        if not len(at):
            return np.zeros(0, dtype), rows
        begin = np.concatenate([[0], at]) if at[0] else at  # a fragment is a word and the white space behind it
        codes, distinct = distinct_fragments(data, begin)
        hold_alone(self)
        if len(self.known) > self.most:
            self.forget()
        known, compute = self.known, self.compute
        values = []
        for fragment in distinct:
            value = known.get(fragment)
            if value is None:
                value = known[fragment] = compute(fragment.rstrip(b" \t\n\x0b\x0c\r"))
            values.append(value)
        return np.array(values, dtype)[codes][len(begin) - len(at) :], rows
