"""Repeated-phrase automata: passages of 50 words that stand in a document with a smaller id.

A sorted order of phrases confirms which recur (see ``repeats``). The phrases confirmed for a piece of
documents are compiled into an automaton, the documents are streamed through it, and only windows
around its hits are looked at: what it does not locate is not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialflow.llm import repeats
from trialflow.llm import text as tx
from trialflow.llm.anchors import Anchors

WINDOW = 50
#: Words of a phrase that an automaton looks for.
PHRASE = 8
#: Words are spelled as one code point each, so many bits of their hash.
_SYMBOL_BITS = 19
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = tx.words(data, offsets)
    return tx.word_hashes(data, start, end), first


def symbols(codes: np.ndarray) -> str:
    """A word per code point (surrogates left out): the automata's nodes are words, not letters."""
    point = (codes >> np.uint64(64 - _SYMBOL_BITS)).astype("<u4") + np.uint32(0x1000)
    point[point >= 0xD800] += np.uint32(0x800)
    return point.tobytes().decode("utf-32-le")


def spell(codes: np.ndarray, at: np.ndarray) -> list[str]:
    """The phrases that begin at some words."""
    spelled = symbols(codes)
    return [spelled[i : i + PHRASE] for i in at.tolist()]


def locate(codes: np.ndarray, texts: np.ndarray, phrases: list[str]) -> np.ndarray:
    """Where the confirmed phrases begin in the texts (first word, end of each), in order.

    The phrases are those confirmed for a piece of documents, and one automaton of them all is a shard
    of bounded size; every document of the piece that has one is streamed through it.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in phrases:
        automaton.add_word(phrase)
    automaton.make_automaton()
    spelled, hits = symbols(codes), []
    for i, j in texts.tolist():
        if j - i >= WINDOW:
            hits += [end - PHRASE + 1 for end, _ in automaton.iter(spelled, i, j)]
    return np.array(hits, np.int64)


def _leading(data: np.ndarray, first: np.ndarray, found: Anchors) -> list[np.ndarray]:
    return [found.gram]


WORDS = repeats.Tokens(_codes, WINDOW, PHRASE, _leading, 1, spell, locate)


def remove_passages(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (NULL without ``texts``).

    A word is removed if a window of WINDOW words over it also starts in a document with a smaller
    doc_id. The kept words are joined by one space.

    NULL texts have no words; texts of fewer words lose nothing; rows without id lose nothing and
    take nothing; rows that repeat an id are one document and never remove each other's; an empty
    table gives an empty result; other columns are not read.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in tx.pieces(batch):
                first, gone = repeats.covered(piece, data, offsets, WORDS)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
                flat, kept = data.tobytes(), []
                for k, n in enumerate(removed.tolist()):
                    words = flat[offsets[k] : offsets[k + 1]].split()
                    if n:
                        words = [w for w, g in zip(words, gone[first[k] : first[k + 1]].tolist()) if not g]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.diff(first)), pa.array(removed),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode() for k in kept] if texts else [None] * len(kept), pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return repeats.with_repeats(docs, WORDS).mapInArrow(finish, RESULT)
