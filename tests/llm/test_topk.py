import math
import random

import numpy as np
import pytest

from tidelake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block int, cell string, vector string, rank int"


def ints(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, k, every):
    known = [(i, ints(v)) for i, v in rows if ints(v) is not None]
    out = []
    for q, x in known:
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in known if i != q)
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(spark, rows, **how):
    got = topk.top_k(spark.createDataFrame([(i, v, 1, 2, "clash", "clash", 3) for i, v in rows], SCHEMA), **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(n, width, seed, kinds=("random", "same", "scaled", "block")):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, width))
    out = []
    for _ in range(n):
        kind = kinds[r.integers(len(kinds))]
        x = {"random": r.normal(size=width), "same": middle[0], "scaled": middle[1] * r.uniform(-3, 3), "block": np.repeat(r.normal(size=max(1, width // 4)), 4)[:width]}[kind]
        out.append([float(np.float32(a)) for a in x / 5])
    return out


@pytest.mark.parametrize(("n", "width", "how"), [(700, 16, {}), (400, 64, {"k": 3, "every": 20}), (300, 7, {"every": 1, "k": 2}), (120, 1, {"every": 5}), (4, 8, {"every": 2})])
def test_against_brute_force(spark, n, width, how):
    rows = list(enumerate(vectors(n, width, n)))
    assert found(spark, rows, **how) == brute(rows, how.get("k", 5), how.get("every", 50))


def test_nulls_ties_repeats_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0]), (2, []), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (-50, [-0.001, 0.5]), (9, [0.25, -inf])]
    assert found(spark, rows) == brute(rows, 5, 50)
    assert [r[2] for r in sorted(found(spark, rows)) if r[0] == 0] == [7, 8, 8, None, None]
    assert found(spark, []) == [] and found(spark, [(50, None)]) == []
    assert found(spark, [(50, [1.0]), (50, [2.0])]) == []


def test_small_blocks_and_large_numbers(spark, monkeypatch):
    """Many blocks on both sides; sums beyond 53 bits are exact."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "BLOCK", 50)
    r = random.Random(3)
    rows = [(i, [r.uniform(-5e5, 5e5) for _ in range(12)]) for i in range(400)]
    assert found(spark, rows, every=10) == brute([(i, [float(np.float32(a)) for a in v]) for i, v in rows], 5, 10)


def test_bounds_hold_and_prune():
    x = np.array(vectors(400, 64, 5), np.float32)
    x = np.floor(256 * x.astype(np.float64)).astype(np.int32)
    exact = topk.products(x, x)
    last = None
    for s in topk.resolutions(64):
        bound = topk.statistics(x, s) @ topk.statistics(x, s).T
        assert (bound >= exact - 1e-3).all()
        assert last is None or bound.sum() <= last
        last = bound.sum()
    # Directions that few segments tell apart: most pairs are never multiplied.
    r = np.random.default_rng(1)
    steps = np.repeat(r.normal(size=(3000, 4)), 16, axis=1) * 100
    steps = (steps + r.normal(size=steps.shape)).astype(np.int32)
    *_, multiplied = topk.search(steps[:50], np.arange(50), np.full(50, np.iinfo(np.int64).min), steps, lambda a, b: a != b, 5)
    assert multiplied < 50 * 3000 * 0.75
    *_, again = topk.search(steps[:50], np.arange(50), np.sort(topk.products(steps[:50], steps), axis=1)[:, -6], steps, lambda a, b: a != b, 5)
    assert again < 50 * 3000 * 0.05
