"""Suffix-array dedup: bytes that stand in a 50-byte string of a document with a smaller id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialflow.llm import repeats
from trialflow.llm import text as tx
from trialflow.llm.anchors import Anchors

WINDOW = 50
#: Leading bytes by which suffixes are put in order.
LEADING = 24
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tx._VALUE[data], offsets


def _leading(data: np.ndarray, first: np.ndarray, found: Anchors) -> list[np.ndarray]:
    """The LEADING bytes of the suffixes at the anchors, eight in a number, so that numbers sort as the bytes do."""
    at = found.place + first[found.row]
    columns = []
    for k in range(0, LEADING, 8):
        column = np.zeros(len(at), np.uint64)
        for j in range(k, k + 8):
            column = column << np.uint64(8) | data[at + j].astype(np.uint64)
        columns.append(column)
    return columns


BYTES = repeats.Tokens(_codes, WINDOW, LEADING, _leading, LEADING // 8)


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (NULL without ``texts``).

    A byte is removed if a WINDOW-byte string over it also starts in a document with a smaller
    doc_id. What is kept may be cut within a character: ``kept`` then has U+FFFD for the rest of it,
    while the digest is of the bytes.

    NULL and empty texts, and texts of fewer bytes, lose nothing; rows without id lose nothing and
    take nothing; rows that repeat an id are one document and never remove each other's; an
    empty table gives an empty result; other columns are not read.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                first, gone = repeats.covered(piece, data, offsets, BYTES)
                rises = gone & ~np.concatenate(([False], gone[:-1]))
                begins = first[:-1][first[:-1] < len(data)]
                rises[begins] = gone[begins]
                removed, spans = (np.concatenate(([0], np.cumsum(c)))[first] for c in (gone, rises))
                kept = [data[i:j][~gone[i:j]].tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(np.diff(spans)),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode(errors="replace") for k in kept] if texts else [None] * len(kept), pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return repeats.with_repeats(docs, BYTES).mapInArrow(finish, RESULT)
