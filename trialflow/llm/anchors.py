"""Windows of texts grouped under the anchors that equal windows share."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from trialflow.llm.text import _BASE, _INVERSE, _powers, mix64

_PLACE_BITS = 30
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


class Anchors(NamedTuple):
    """Runs of windows of a piece: text, first window start and k-gram place (in the text), windows,
    hashes of the k-gram and of all that the run covers."""

    row: np.ndarray
    start: np.ndarray
    place: np.ndarray
    n: np.ndarray
    gram: np.ndarray
    block: np.ndarray


class Sums:
    """Prefix sums over token codes, from which the hash of any stretch follows."""

    def __init__(self, codes: np.ndarray) -> None:
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(_BASE, len(codes)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(codes) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix64((self.sums[k:] - self.sums[:n]) * self.back[:n])


def find_anchors(codes: np.ndarray, first: np.ndarray, window: int, k: int, sums: Sums | None = None) -> Anchors:
    """Every window of ``window`` tokens within a text, under the leftmost least k-gram that it holds.

    Which k-gram that is depends on the window's tokens alone, so equal windows in any two texts
    have the same k-gram at the same place. Windows that follow each other under one k-gram are one run.
    """
    sums = sums or Sums(codes)
    n = len(codes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = sums.grams(k)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    owner = (least[:n] & _PLACE).astype(np.int64)
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)[:n]
    inside = np.arange(n) + window <= first[row + 1]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]))) & inside
    at = np.flatnonzero(new)
    ends = np.append(at[1:], n)
    whole = np.concatenate(([0], np.cumsum(inside)))
    count = whole[ends] - whole[at]
    return Anchors(row[at], at - first[row[at]], owner[at] - first[row[at]], count, grams[owner[at]], sums.hash(at, at + count - 1 + window))
