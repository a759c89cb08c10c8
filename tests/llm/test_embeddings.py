"""The grid order join beside all pairs, with sequences so small that they are cut and skipped."""

import math
import random

import numpy as np
import pytest

from trialflow.llm import embeddings

ROWS = "vec_id long, embedding array<double>, label int, id long, links long, cells string, dim int"


def brute_force(rows, cosine):
    """id -> (links, component), ids being places in ``rows``."""
    def good(i):
        vec_id, v, label = rows[i]
        return vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for i, (_, v, _) in enumerate(rows) if good(i)}
    near = {i: [j for j in unit if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] if i in unit else [] for i in range(len(rows))}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in near[j] if k not in seen and not seen.add(k)]
        least = min(rows[j][0] for j in seen) if vec_id is not None else None
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return sorted(out, key=str)


def planted(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n // 10):
        centre, label = rng.normal(size=dim), int(rng.integers(3)) if c % 2 else 0
        for k in range(10):
            noise = rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.14, 0.3])
            rows.append((len(rows), ((centre + noise) * rng.choice([1, 3.5])).tolist(), label))
    # A chain whose ends are far apart, and many copies of one vector.
    for k in range(30):
        rows.append((len(rows), [math.cos(k / 6), math.sin(k / 6), *[0.0] * (dim - 2)], 1))
    return rows + [(len(rows) + k, [1.0] * dim, 2) for k in range(25)]


ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 6, 1), (9004, [1.0, None, 1.0], 1), (9005, [math.nan, 1.0], 1), (9006, [math.inf, 1.0], 1),
    (9007, [1.0] * 6, None), (9008, [1e300] * 6, 2), (9009, [5e-320] * 6, 2), (9010, [1.0] * 3, 2), (None, [1.0] * 6, 2), (9011, [1.0, 1.0, 1.0], 2), (9011, [1.0, 1.0, 1.0], 2),
]


@pytest.mark.parametrize("sequence, leaf, cosine", [(16, 4, 0.98), (2048, 256, 0.98), (16, 4, 0.6)])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, sequence, leaf, cosine):
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    rows = [r for r in planted(200, 6) + ODD if r[1] is None or 5e-320 not in r[1]]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], ROWS)
    got = embeddings.near_duplicates(frame, cosine=cosine, sequence=sequence)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute_force(rows, cosine)
    want = [w if w[0] is not None else (None, 0, None, True) for w in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_distant_sequences_are_skipped():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4096, 3))
    axes = np.eye(3)
    side = math.sqrt(2 - 2 * 0.999)
    at = embeddings._project(vectors, axes)
    order = np.lexsort(np.floor(at / side).T[::-1])
    one = embeddings.Sequence(np.arange(4096), np.ones(4096, int), vectors[order], axes)
    x, y, dense = embeddings.join_sequences(one, one, 0.999, side)
    near = np.triu(one.units @ one.units.T >= 0.999, 1)
    assert sorted(zip(x.tolist(), y.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert dense < 0.6 * 136


def test_axes_change_no_link(spark, monkeypatch):
    rows = planted(100, 6)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, embeddings.near_duplicates(frame, sequence=32).collect()))
    monkeypatch.setattr(embeddings, "principal_axes", lambda reps: np.eye(6)[:, ::-1][:, :2])
    assert sorted(map(tuple, embeddings.near_duplicates(frame, sequence=32).collect())) == whole


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, 1, 1, 1, "", 1)], ROWS)).collect()[0]["kept"]
