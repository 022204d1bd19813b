import random
from collections import Counter

import numpy as np

from tidelake.llm import suffix_dedup as s


def brute(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(t), int(gone.sum()), spans, bytes(c for c, g in zip(t, gone, strict=False) if not g)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passages = [some(n) for n in (150, 390, 400, 420, 500, 900, 2000)]
    rows = []
    for i in range(60):
        text = some(r.randint(0, 900))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            at = r.randint(0, len(text))
            text = text[:at] + p[r.randint(0, 60) :][: r.choice((5000, 450, 700))] + text[at:]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 401), (103, "a" * 399), (104, "ab" * 700), (105, "xyz" * 133 + "x"), (106, passages[6]), (106, passages[6]), (None, passages[3]), (107, some(30) + passages[2]), (108, "é" * 300)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, batch int")
    want = brute(rows)
    assert sum(r[2] for r in want) > 5000
    for size in (2 << 20, 6000):
        got = s.remove_repeats(frame, batch_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in got), key=str) == want, size


def test_planted_passages(spark):
    """Passages of over 50 words: from 400 bytes on cut at both places, and only there; shorter ones stay."""
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 10))) for _ in range(n))
    rows, long = [], {}
    for k in range(0, 120, 3):
        p = words(r.randint(51, 80))
        for i in (k, k + 1):
            rows.append((i, f"{words(30)} {i - k}\n{p}\n{i - k} {words(30)}"))
            long[i] = len(f"\n{p}\n") >= 400
        rows.append((k + 2, words(120)))
    assert 10 < sum(long.values()) < 70
    got = s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=20_000).collect()
    assert {r.doc_id: r.n_bytes - len(r.kept) >= 400 for r in got} == {i: long.get(i, False) for i, _ in rows}
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in got), key=str) == brute(rows)


def later(rows, length=400):
    """By (id, text): how many bytes a string covers that also starts at a smaller id (null first, equal ids by text) or before in the text."""
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            gone[k : k + length] |= t[k : k + length] in seen
            seen.add(t[k : k + length])
        out.append((i, len(t), int(gone.sum())))
    return sorted(out, key=str)


def test_later_copies_are_told_from_first_ones(spark):
    """A first copy goes as well, but n_later counts only what also starts earlier."""
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = later(rows)
    assert sum(n for *_, n in want) > 5000
    for size in (2 << 20, 6000):
        got = s.remove_repeats(frame, batch_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_later) for r in got), key=str) == want, size
    passage = "".join(random.Random(3).choices("abcdefgh ", k=500))
    got = {r.doc_id: (len(r.kept), r.n_later) for r in s.remove_repeats(spark.createDataFrame([(9, "x" + passage), (4, passage + "y"), (7, "z")], "doc_id long, text string")).collect()}
    assert got == {4: (1, 0), 9: (1, 500), 7: (1, 0)}


def test_segments_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT", 700)
    import pyarrow as pa

    texts = [t.encode() for _, t in corpus() if t]
    batch = s.Batch(pa.table({"batch": [0] * len(texts), "doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary())}))
    monkeypatch.setattr(s, "SEGMENT", 1 << 20)
    again = s.Batch(pa.table({"batch": [0] * len(texts), "doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary())}))
    assert (batch.high - batch.low >= 0).all()
    # equal texts have anchors at equal places, however they are cut up
    assert (batch.hash[0].of(batch.anchor, batch.anchor + s.ANCHOR)[:50] == again.hash[0].of(again.anchor, again.anchor + s.ANCHOR)[:50]).all()


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
