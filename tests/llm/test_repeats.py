"""Ordered records and located phrases: packing, cuts in the middle of groups, and what no automaton finds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trialflow.llm import phrases, repeats, substrings
from trialflow.llm import text as tx
from trialflow.llm.anchors import find_anchors


def test_records_survive_packing():
    rng = np.random.default_rng(1)
    for n_lead, top in ((3, 1 << 20), (1, 1 << 62)):
        doc = rng.integers(-top, top, 500)
        records = (*rng.integers(0, 1 << 63, (n_lead, 500), dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64), doc)
        base, lead, blob = repeats._pack(records)
        assert all((a == b).all() for a, b in zip(repeats._unpack(500, base, lead, blob, n_lead), records))


def test_suffixes_sort_as_their_bytes_do():
    rng = random.Random(2)
    data = "".join(rng.choice("ab ä") for _ in range(3000)).encode()
    flat, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    codes, first = substrings.BYTES.codes(flat, offsets)
    found = find_anchors(codes, first, 50, substrings.LEADING)
    records = (*substrings.BYTES.lead(flat, first, found), found.block, np.zeros(len(found.row), np.int64))
    order = repeats.multikey_order(list(records))
    lead = [data[p : p + substrings.LEADING] for p in found.place[order].tolist()]
    assert lead == sorted(lead)
    as_bytes = [bytes(r).ljust(40, b"\0") for r in repeats._sortable(records)[order].tolist()]
    assert [b[: substrings.LEADING] for b in as_bytes] == lead and as_bytes == sorted(as_bytes)


@pytest.mark.parametrize("n_cuts", [0, 1, 7, 60])
def test_cuts_in_the_middle_of_groups_lose_nothing(n_cuts):
    rng = np.random.default_rng(n_cuts)
    lead = [rng.integers(0, 3, 400).astype(np.uint64) for _ in range(3)]
    records = (*lead, rng.integers(0, 4, 400).astype(np.uint64), rng.integers(0, 30, 400))
    whole = repeats.judge(records, None, None)
    kept = repeats._sorted_records(records)
    rows = repeats._sortable(kept)
    edges = np.sort(rng.choice(rows, n_cuts, replace=False)) if n_cuts else rows[:0]
    ends = np.append(np.searchsorted(rows, edges, "right"), len(rows))
    parts, start = [], 0
    for k, end in enumerate(ends):
        if end > start:
            parts.append(repeats.judge(tuple(c[start:end] for c in kept), edges[k - 1] if k else None, edges[k] if k < len(edges) else None))
        start = end
    doc, key, kind = (np.concatenate(c) for c in zip(*parts))
    told = lambda d, k, x, want: sorted(zip(d[x == want].tolist(), k[x == want].tolist()))
    assert told(doc, key, kind, repeats.REPEATED) == told(*whole, repeats.REPEATED)
    assert set(told(*whole, repeats.OPEN)) <= set(told(doc, key, kind, repeats.OPEN))


def piece_of(text, lists):
    data = np.frombuffer(text.encode(), np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([text]), pa.array([lists], pa.list_(pa.string()))], ["text", "phrases"]), data, np.array([0, len(data)])


def test_runs_are_those_around_the_hits_of_the_automaton():
    rng = random.Random(4)
    text = " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) + str(rng.randrange(9)) for _ in range(600))
    piece, data, offsets = piece_of(text, [])
    codes, first = phrases._codes(data, offsets)
    every = find_anchors(codes, first, phrases.WINDOW, phrases.PHRASE)
    wanted = [3, 7, 8]
    spelled = phrases.spell(codes, every.place[wanted])
    piece, data, offsets = piece_of(text, spelled)
    found = repeats._located(piece, codes, first, phrases.WORDS)
    as_rows = lambda f, keep: {(int(f.start[i]), int(f.place[i]), int(f.n[i]), int(f.block[i])) for i in keep}
    assert as_rows(every, wanted) <= as_rows(found, range(len(found.row)))
    assert len(found.row) < len(every.row) / 2
    piece, data, offsets = piece_of(text, [])
    assert len(repeats._located(piece, codes, first, phrases.WORDS).row) == 0


def test_without_the_automaton_nothing_is_removed(spark, monkeypatch):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(70))
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40)) + " " + passage + " end") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in phrases.remove_passages(docs).collect()}
    assert found == {0: 0, **dict.fromkeys(range(1, 6), 71)}
    deaf = phrases.WORDS.__class__(**{**phrases.WORDS.__dict__, "locate": lambda codes, texts, wanted: np.zeros(0, np.int64)})
    monkeypatch.setattr(phrases, "WORDS", deaf)
    assert {r["n_removed"] for r in phrases.remove_passages(docs).collect()} == {0}


def brute_force(rows, tokens_of):
    """doc -> removed tokens; windows compared as they are."""
    least, held = {}, []
    for i, t in rows:
        own = tokens_of(t.encode())
        held.append((i, own))
        for s in range(len(own) - 49):
            w = tuple(own[s : s + 50])
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, own in held:
        gone = [False] * len(own)
        for s in range(len(own) - 49):
            if least[tuple(own[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        out[i] = sum(gone)
    return out


def test_queries_over_whole_small_tables_equal_brute_force(spark):
    """All documents of the small table."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for remove, tokens_of in ((phrases.remove_passages, bytes.split), (substrings.remove_repeats, bytes)):
        got = {r["doc_id"]: r["n_removed"] for r in remove(docs, texts=False).collect()}
        assert got == brute_force(rows, tokens_of) and any(got.values())


def test_pieces_of_text_are_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(tx, "PIECE_BYTES", 300)
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(n)) for n in (50, 55, 120)]
    rows = [(i, " ".join(rng.sample([*passages, *[f"x{rng.randrange(99)}" for _ in range(20)]], 12))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for remove, tokens_of in ((phrases.remove_passages, bytes.split), (substrings.remove_repeats, bytes)):
        assert {r["doc_id"]: r["n_removed"] for r in remove(docs).collect()} == brute_force(rows, tokens_of)
