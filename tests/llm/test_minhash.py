import random
from collections import Counter

import numpy as np

from tidelake.llm import minhash as m
from tidelake.llm.common import Scratch


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(x, y):
    if not x.keys() & y.keys():
        return 0.0
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    every, common = sorted(x.keys() | y.keys()), sorted(x.keys() & y.keys())
    p, q = (np.array([[z[e] / z.total() for e in every]]) for z in (x, y))
    own = [np.array([[z[d] / z.total()] for d in common]) for z in (x, y)]
    return max(plain, float((1 / np.maximum(p / own[0], q / own[1]).sum(1)).sum()))


def brute_classes(docs, least=0.8):
    ids = sorted(i for i, _ in docs)
    text = dict(docs)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    s = {i: shingles(text[i]) for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (text[i] or "") == (text[j] or "") or brute_similarity(s[i], s[j]) >= least:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def edited(words, r, k):
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return out


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(40):  # apart, though all have a passage in common
        rows.append([r.choice(vocabulary) for _ in range(r.randint(30, 90))] + common)
    base = [r.choice(vocabulary) for _ in range(300)]
    rows += [base] + [edited(base, r, r.choice((1, 2, 3, 4))) for _ in range(30)]  # a large group
    chain = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(9):  # each near the one before only
        rows.append(chain)
        chain = edited(chain, r, 3)
    rows += [["x"] * 50 + ["y"], ["x"] * 60 + ["y"], ["a", "b"], ["A", "B"], ["a", "b", "c"], [], []]
    rows += [list("abcdefgh"), list("abcdefg"), rows[3], rows[3]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_classes_against_all_pairs(spark):
    docs = corpus() + [(900, None)]
    frame = spark.createDataFrame([(i, t, "clash", 5) for i, t in docs] + [(None, "a b", "x", 1), (2, docs[2][1], "x", 1)], "doc_id long, text string, node string, bucket int")
    got = m.classes(frame).collect()
    assert len(got) == len(docs) + 2
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(docs)
    kept = m.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_classes(docs).values())) and ids.count(None) == 1


def test_large_buckets_with_one_hub_lose_no_link(spark, monkeypatch):
    """With every bucket taken for large and one hub each, most links are left to the prefix join."""
    monkeypatch.setattr(m, "SMALL_BUCKET", 1)
    monkeypatch.setattr(m, "HUBS", 1)
    docs = corpus()
    got = m.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs)


def test_links_apart_are_all_links_between_classes(spark, monkeypatch):
    """One bucket of texts that share much: those near and those just too far, some with very uneven counts."""
    monkeypatch.setattr(m, "SMALL_BUCKET", 1)
    r = random.Random(12)
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(edited(base, r, r.randint(0, 5))) for _ in range(60)]
    texts += [" ".join(["x"] * r.randint(20, 80) + edited(base[:30], r, r.randint(0, 2))) for _ in range(30)]
    sets = m.weighted_sets(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    buckets = spark.createDataFrame([(7, i) for i in range(len(texts))], "bucket long, node long")
    s = [shingles(t) for t in texts]
    near = {(i, j) for j in range(len(s)) for i in range(j) if brute_similarity(s[i], s[j]) >= 0.8}
    none = spark.createDataFrame([], "node long, class long")
    assert {tuple(x) for x in m.links_apart(buckets, none, sets, 0.8).collect()} == near
    classes = {i: i % 3 if i < 40 else i for i in range(len(s))}
    label = spark.createDataFrame(list(classes.items()), "node long, class long")
    got = [tuple(x) for x in m.links_apart(buckets, label, sets, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in near if classes[i] != classes[j]}
    assert 100 < len(near) < 3000
    one = spark.createDataFrame([(i, 0) for i in range(len(s))], "node long, class long")
    assert m.links_apart(buckets, one, sets, 0.8).count() == 0


def test_signature_agreement_estimates_similarity():
    r = random.Random(1)
    base = [f"w{k}" for k in range(400)]
    for k in (1, 5, 15):
        a, b = " ".join(base), " ".join(edited(base, r, k))
        owner, shingle, count = m.weighted_shingles([a, b])
        sig = m.signatures(owner, shingle, count.astype(float), 2)
        x, y = [(shingle[owner == t], count[owner == t].astype(float)) for t in (0, 1)]
        assert abs((sig[0] == sig[1]).mean() - brute_similarity(shingles(a), shingles(b))) < 0.16
        assert abs(m.similarity(x, y) - brute_similarity(shingles(a), shingles(b))) < 1e-9


def test_exact_similarity_of_weighted_sets():
    r = random.Random(8)
    for _ in range(200):
        a, b = (" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(2))
        owner, shingle, count = m.weighted_shingles([a, b])
        x, y = [(shingle[owner == t], count[owner == t].astype(float)) for t in (0, 1)]
        assert abs(m.similarity(x, y) - brute_similarity(shingles(a), shingles(b))) < 1e-9
    assert np.isfinite(m.signatures(*m.weighted_shingles(["a"]), 1)).all()


def test_empty(spark):
    assert m.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.keep_one(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1


def test_near_copies_with_a_line_repeated_dozens_of_times(spark):
    """Sets agree, counts do not: candidates must come from the sets."""
    r = random.Random(21)
    docs, apart = [], 0
    for k in range(40):
        base, line = [f"g{k}w{r.randrange(900)}" for _ in range(300)], [f"g{k}line{j}" for j in range(10)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + line * r.choice((30, 40, 60))))]
        x, y = shingles(docs[-2][1]), shingles(docs[-1][1])
        apart += brute_similarity(Counter(dict.fromkeys(x, 1)), Counter(dict.fromkeys(y, 1))) >= 0.8
    docs += [(200, " ".join(base + line)), (201, " ".join(base + line * 40)), (202, " ".join(base * 2 + line * 2))]
    got = m.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert apart == 40
    assert {x.doc_id: x.class_id for x in got} == brute_classes(docs)


def test_components_of_chains_and_stars(spark, monkeypatch, tmp_path):
    """By rounds of contraction down to few links, and by one task."""
    r = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200 + a, 200 + b) for a, b in (r.sample(range(50), 2) for _ in range(40))]
    links += [links[5], (300, 301)]
    frame = spark.createDataFrame([tuple(sorted(x)) for x in links], "a long, b long")
    up = {}
    for a, b in sorted(map(sorted, links)) * 60:
        up[a] = up[b] = min(up.get(a, a), up.get(b, b))
    whole = {}
    for limit in (1 << 20, 3):
        monkeypatch.setattr(m, "LINKS_AT_ONCE", limit)
        with Scratch(spark) as scratch:
            got = {x.node: x["class"] for x in m.components(frame, scratch).collect()}
            assert m.components(frame.limit(0), scratch).count() == 0
        for a in got:
            whole.setdefault((limit, got[a]), set()).add(a)
        assert got.keys() == up.keys()
    groups = {frozenset(i for i in up if up[i] == c) for c in set(up.values())}
    assert {frozenset(g) for (k, _), g in whole.items() if k == 3} == groups == {frozenset(g) for (k, _), g in whole.items() if k > 3}


def test_likely_rows_hold_all_wanted(spark, monkeypatch):
    rows, wanted = spark.range(5000).withColumnRenamed("id", "doc_id"), spark.range(0, 5000, 50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in m.likely(rows, wanted).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 1000
    assert m.likely(rows, wanted.limit(0)).count() == 0
    monkeypatch.setattr(m, "MOST_BITS", 64)
    assert {r.doc_id for r in m.likely(rows, rows).collect()} == set(range(5000))


def test_keep_one_of_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f g h", "x", "p", "q"), (2, "a b c d e f g h", "y", "r", "s"), (3, None, "z", "t", "u"), (None, "a b", "w", "v", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc_id_of_class string, __text_key_of_class string, __id string")
    got = m.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.doc_id != 2)
