"""Words one edit apart beside all pairs, with blocks so small that groups are cut into tiles."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trialflow.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(counts, ratio=5):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (form, n, len(near), counts[form] if form is not None else None)
    out = []
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.append((w, form, root, n, n_near, form_n))
    return sorted(out)


def vocabulary(seed, n):
    rng = random.Random(seed)
    counts = {}
    for _ in range(n):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
        counts[word] = rng.choice([1, 5, 7, 30, 36, 200, 1000, 5000, 5000])
        if rng.random() < 0.6:
            k = rng.randrange(len(word))
            counts.setdefault(word[:k] + rng.choice(["", "a", "ÿ", "ab"]) + word[k + 1 :], rng.randrange(1, 40))
    counts.pop("", None)
    return counts


@pytest.mark.parametrize("block", [3, 40, 512])
def test_forms_and_roots_equal_all_pairs(spark, block):
    counts = vocabulary(4, 300) | {"x" * 3000: 50, "x" * 2999: 3, "x" * 1500 + "y" + "x" * 1499: 8, "𝒳𝒴abcd": 40, "𝒳abcd": 5, "abcdef": 25, "abcdeg": 25, "abcdeh": 5}
    words = spark.createDataFrame([(w, n, 1, "m", 0) for w, n in counts.items()], "word string, n int, i int, half string, best int")
    got = spelling.variant_groups(words, block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_force(counts)
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_prefix_and_suffix_of_a_tile_tell_single_edits():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(6 + i % 2)) for i in range(150)})
    both = [spelling.near_in_tile(words, None, 6, half) for half in (0, 1)]
    got = [(words[i], words[j]) for x, y in both for i, j in zip(x.tolist(), y.tolist())]
    short = [(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b) and 6 in (len(a), len(b))]
    assert sorted(got) == sorted(short)


def test_words_of_whole_texts_and_slips(spark):
    rng = random.Random(9)
    pool = ["Straße", "couleur", "NATION", "nation", "ßßßßßßß", "letters", "÷×÷×÷×÷", "short", "a" * 40]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice([".", "1", "_", "-", "ā", ""]) for _ in range(200))) for i in range(40)]
    rows += [(None, "letters " * 300), (7, None), (8, ""), (9, "12 34"), (10, "letters, " * 20000), (10, "letters, " * 3)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], "doc_id long, text string, word string, n int, run string")
    assert {r["word"]: r["n"] for r in spelling.count_words(docs, slip=3).collect()} == want
    assert sorted(map(tuple, spelling.spelling_variants(docs, slip=3).collect())) == brute_force(want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_code_points_are_padded_on_either_side():
    sizes, left, right = spelling.code_points(["ab", "", "éxyz"], 4)
    assert sizes.tolist() == [2, 0, 4] and left[0].tolist() == [97, 98, 0, 0] and right[0].tolist() == [0, 0, 97, 98]
    assert (left[2] == right[2]).all() and not np.any(left[1])
