"""CRC-32 of many byte strings at once: it is linear, so each byte adds a term that depends on its distance from the end."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes up to which strings are summed from tables; longer ones are hashed one by one.
TABLE_BYTES = 64
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_TABLE = _byte_table()


def _step(state: np.ndarray) -> np.ndarray:
    """The state after one more zero byte."""
    return _TABLE[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _repeated(start: np.ndarray, n: int) -> np.ndarray:
    out = [start]
    for _ in range(n):
        out.append(_step(out[-1]))
    return np.array(out)


#: What a byte adds to the state at each distance from the end, and what the initial state adds for each length.
_TERMS = _repeated(_TABLE, TABLE_BYTES - 1)
_START = _repeated(np.array([_ALL]), TABLE_BYTES)[:, 0]
#: The same for each byte of a state, to move it on by a number of zero bytes.
_MOVES = np.stack([_repeated((np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32), TABLE_BYTES) for k in range(4)], axis=1)


def crc_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the strings data[start:end], none of them empty, in order and not overlapping."""
    size = end - start
    before = np.cumsum(size) - size
    at = np.repeat(start - before, size) + np.arange(size.sum())
    from_end = np.repeat(end - 1, size) - at
    terms = _TERMS[np.minimum(from_end, TABLE_BYTES - 1), data[at]]
    out = np.bitwise_xor.reduceat(terms, before) if len(size) else np.zeros(0, np.uint32)
    out = out ^ _START[np.minimum(size, TABLE_BYTES)] ^ _ALL
    for k in np.flatnonzero(size > TABLE_BYTES).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return out


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each first string followed by its second, whose CRC-32 and number of bytes are given."""
    out = second.copy()
    rest, state = size, first
    while len(rest) and (rest > TABLE_BYTES).any():
        far = rest > TABLE_BYTES
        state = np.where(far, _move(state, np.full(len(state), TABLE_BYTES)), state)
        rest = np.where(far, rest - TABLE_BYTES, rest)
    return out ^ _move(state, rest)


def _move(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(state), np.uint32)
    for k in range(4):
        out ^= _MOVES[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def followed_by(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC-32 of each string followed by one byte."""
    state = crc ^ _ALL
    return (_TABLE[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))) ^ _ALL
