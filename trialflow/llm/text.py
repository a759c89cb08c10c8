"""Words of Arrow batches as arrays: offsets and hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a task (one longer text is worked on alone).
PIECE_BYTES = 1 << 20
#: ASCII white space, the only bytes between words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()) if column.type != pa.large_string() else column


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a large_string array; NULL has no bytes. The data are not copied."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes of text: (rows, data, offsets)."""
    texts = text_array(batch.column(column))
    data, offsets = bytes_of(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and the number of words before each text."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step & ((1 << 64) - 1)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words in every task."""
    seen = _LOWER[data] if lower else data
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[seen] * _powers(_BASE, len(data)), out=sums[1:])
    return mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start])
