import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest int, proof string, items int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def above(level, arity):
    return [H(*level[k : k + arity]) for k in range(0, len(level), arity)]


def proofs(level, arity):
    """(top, siblings of each node: a (left, right) a level)."""
    steps, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for node, k in enumerate(at):
            run = k // arity * arity
            steps[node].append(("".join(level[run:k]), "".join(level[k + 1 : run + arity])))
        level, at = above(level, arity), [k // arity for k in at]
    return level[0], steps


def brute(rows, arity=2):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    tops, leaves = [], []
    for t in order:
        kept = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        top, steps = proofs([leaf(*r) for r in kept], arity)
        tops.append(top)
        leaves.append((kept, steps))
    root, upper = proofs(tops, arity) if tops else (None, [])
    out = []
    for top, more, (kept, steps) in zip(tops, upper, leaves):
        for r, own in zip(kept, steps):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf(*r[:3], r[3] + 1, r[4]) if tampered else leaf(*r)
            for left, right in own + more:
                h = H(left, h, right)
            out.append((r[0], leaf(*r), top, root, H(*[a + b for a, b in own + more]), h, h == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    r = random.Random(seed)
    return [(r.randint(0, 400) if r.random() < 0.95 else None, r.choice(["a", "b", None]), r.choice(langs), r.choice([None, 0, 7, -3]), r.choice(["", "é\U0001f600\n", "x" * 50, None])) for _ in range(n)]


def audit(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.audit(docs, tampered, {"n_chars": F.col("n_chars") + 1}, **how)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("n", "langs", "how"), [(300, ["en", "de", "", None, "é"], {}), (1, ["en"], {}), (70, ["en"], {"height": 1}), (200, [None, *map(str, range(90))], {"arity": 3, "height": 2}), (65, ["en"], {"height": 6})])
def test_against_brute_force(spark, n, langs, how):
    rows = rows_of(n, langs)
    got = audit(spark, rows, **how)
    assert got == brute(rows, how.get("arity", 2))
    assert {True} <= {r[-1] for r in got}


def test_sizes_around_a_page(spark):
    """Trees of every size about one and two pages, in one forest."""
    rows = [(i, "s", f"t{n}", i, "x") for n in [*range(1, 10), 15, 16, 17, 31, 33] for i in range(n)]
    assert audit(spark, rows, height=2) == brute(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, "s", "en", 2_000_000, "lorem ipsum é " * 150_000), (2, "s", "en", 0, "")]
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, []) == []


def test_refuses_no_tree(spark):
    with pytest.raises(ValueError):
        audit(spark, rows_of(3, ["en"]), arity=1)
