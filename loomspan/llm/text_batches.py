"""Code points and words of many texts at once, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_lower: np.ndarray | None = None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives its free memory back to the system now and then and when the task ends."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, out in enumerate(run(batches)):
                yield out
                del out
                if i % 8 == 7:
                    release()
        finally:
            release()

    return tidied


def release() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it otherwise, and workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def code_points(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of concatenated texts, and each text's bounds in them."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return points, np.searchsorted(at, offsets)


def lower_table() -> np.ndarray:
    """For each code point its lower case, if that is one code point; white space becomes a blank."""
    global _lower
    if _lower is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            if not 0xD800 <= c < 0xE000:
                s = chr(c).lower()
                table[c] = 32 if chr(c).isspace() else ord(s) if len(s) == 1 else c
        _lower = table
    return _lower


def ascii_words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds (from, to) of the runs of other than ASCII white space, and words before each text's start."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, offsets)


def coded(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each piece of ``data``, equal for equal pieces, and the distinct pieces."""
    bounds = np.empty(2 * len(begins) + 1, np.int32)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = begins, ends, ends[-1] if len(ends) else 0
    pieces = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    found = pieces.take(pa.array(np.arange(0, 2 * len(begins), 2))).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary
