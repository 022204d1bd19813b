import hashlib
import math

import numpy as np
import pytest
from tests.llm.test_topk import ints, vectors

from tidelake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, slot int, code string, n string, __label int"


def brute(rows, parts, entries, rounds):
    known = [(i, ints(v), label) for i, v, label in rows if ints(v) is not None]
    width = max(1, -(-max((len(v) for _, v, _ in known), default=0) // parts)) * parts
    known = [(i, v + [0] * (width - len(v)), label) for i, v, label in known]
    size = width // parts
    first = sorted(known, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e)), c) for c, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        codes = [assign(v) for _, v, _ in known]
        for p in range(parts):
            for c in range(len(books[p])):
                mine = [v[p * size : (p + 1) * size] for (_, v, _), code in zip(known, codes) if code[p][1] == c]
                if mine:
                    books[p] = [*books[p][:c], [math.floor(sum(x) / len(mine)) if abs(sum(x)) < 2**40 else sum(x) // len(mine) for x in zip(*mine)], *books[p][c + 1 :]]
    print_ = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{c:02x}" for _, c in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in known]
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], print_) for i, code, error, label in out), key=str)


def found(spark, rows, **how):
    got = vc.compress(spark.createDataFrame([(i, v, label, 1, "clash", "clash", 2) for i, v, label in rows], SCHEMA), **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(250, 32, 16, 64, 2), (150, 8, 4, 20, 3), (40, 10, 4, 64, 2), (90, 6, 2, 1, 1)])
def test_against_brute_force(spark, n, width, parts, entries, rounds):
    rows = [((7 * i) % n, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors(n, width, n))]
    assert found(spark, rows, parts=parts, entries=entries, rounds=rounds) == brute(rows, parts, entries, rounds)


def test_nulls_repeats_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0], None), (3, [1.0, 2.0, 3.0], None), (3, [0.5], 1), (None, [4.0, -0.001], 1), (1, None, 1), (2, [nan], 1), (2, [inf, 1.0], 1), (2, [None], 1), (9, [], 2)]
    assert found(spark, rows, parts=2, entries=3) == brute(rows, 2, 3, 2)
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_tree_equals_all_distances():
    r = np.random.default_rng(4)
    for kind in range(6):
        book = r.integers(-3, 4, (64, 4)) if kind < 2 else r.integers(-200, 200, (64, 4)) if kind < 4 else r.integers(-(1 << 27), 1 << 27, (64, 4))
        points = np.vstack([r.integers(book.min(), book.max() + 1, (500, 4)), book])
        square = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, best, looked = vc.nearest(book, vc.grow(book, np.arange(64)), points)
        assert (code == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
    assert looked < square.size


def test_no_half_is_missed_when_all_entries_are_equal():
    book = np.full((30, 3), 5)
    code, best, _ = vc.nearest(book, vc.grow(book, np.arange(30)), np.array([[5, 5, 5], [0, 0, 0]]))
    assert code.tolist() == [0, 0] and best.tolist() == [0, 75]
