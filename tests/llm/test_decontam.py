import math
import random

from tidelake.llm import decontam as d


def brute(docs, items, least=13, share=0.8):
    """Every diagonal of every pair that has a seed on it, stretches scored one by one."""
    out = {}
    for doc, text in docs:
        a = d.tokens(text or "")
        for item, other in items:
            b = d.tokens(other or "")
            best = None
            for diagonal in range(-len(b) + 1, len(a)):
                same = [(i, a[i] == b[i - diagonal]) for i in range(max(0, diagonal), min(len(a), len(b) + diagonal))]
                hit = dict(same)
                seeded = any(all(hit.get(i + int(o)) for o in offs) for offs in d.mask_offsets(len(b)) for i, _ in same)
                if not seeded:
                    continue
                top = None
                for s in range(len(same)):
                    score = 0
                    for e in range(s, len(same)):
                        score += d.MATCH if same[e][1] else d.MISMATCH
                        if top is None or score > top[0]:
                            top = (score, s, e + 1)
                if top is None:
                    continue
                _, s, e = top
                equal = sum(x for _, x in same[s:e])
                if e - s >= min(least, math.ceil(share * len(b))) and equal >= share * (e - s):
                    rank = (e - s, equal, -same[s][0])
                    best = max(best, rank) if best else rank
            if best:
                out[doc, item] = best
    return out


def tables():
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((3, 5, 9, 14, 20, 40))] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for i in range(60):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            part = items[i // 3 % 6][1].split()
            for _ in range(i % 4):
                part[r.randrange(len(part))] = "SUBST"
            text[10:10] = part
        docs.append((i, " ".join(text) + "."))
    return docs + [(100, None), (101, ""), (102, items[4][1].upper() + "!")], items


def test_both_ways_against_brute_force(spark):
    docs, items = tables()
    left = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert (102, 4) in want and len(want) > 10
    for limits in ({}, {"broadcast_items": 2}):
        got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_equal, -r.doc_start) for r in d.overlaps(left, right, stretch="top", **limits).collect()}
        assert got == want, limits
        kept = {r.doc_id for r in d.drop_contaminated(left, right, stretch="top", **limits).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g"), (7, "a b c")], "item_id long, text string")
    for limits in ({}, {"broadcast_items": 0}):
        assert {(r.doc_id, r.item_id, r.n_tokens) for r in d.overlaps(docs, items, **limits).collect()} == {(1, 7, 7), (None, 7, 7)}
        assert d.overlaps(docs.limit(0), items, **limits).count() == 0
        assert d.overlaps(docs, items.limit(0), **limits).count() == 0
        assert d.drop_contaminated(docs, items, **limits).count() == 0


def by_definition(docs, items, least=13, share=0.8):
    """Every stretch of every diagonal of every pair, by the docstring of overlaps()."""
    out = {}
    for doc, text in docs:
        a = d.tokens(text or "")
        for item, other in items:
            b = d.tokens(other or "")
            need = min(least, math.ceil(share * len(b)))
            for diagonal in range(-len(b) + 1, len(a)):
                lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
                for s in range(lo, hi - need + 1):
                    equal = 0
                    for e in range(s, hi):
                        equal += a[e] == b[e - diagonal]
                        if e + 1 - s >= need and 5 * equal >= 4 * (e + 1 - s):
                            out[doc, item] = max(out.get((doc, item), (0,)), (e + 1 - s, equal, -s))
    return out


def replaced(item, *at):
    return " ".join("SUBST" if k in at else w for k, w in enumerate(item.split()))


def test_longest_stretch_by_definition(spark):
    docs, items = tables()
    words = [f"v{k}" for k in range(60)]
    items += [(200 + n, " ".join(words[:n])) for n in (*range(4, 18), 20, 27, 40)]
    text = dict(items)
    leaks = [replaced(text[213], 8), replaced(text[216], 7, 8), replaced(text[220], 5, 9, 13), replaced(text[227], 12, 13, 14), replaced(text[215], 3, 7, 11)]
    leaks += [replaced(text[200 + n], k) for n in range(5, 10) for k in range(n)]
    r = random.Random(7)
    leaks += [replaced(text[200 + n], *(r.randrange(n) for _ in range(n // 5 + 1))) for n in (10, 11, 12, 13, 14, 15, 16, 17, 20, 40) for _ in range(3)]
    docs += [(1000 + k, f"before {t} after") for k, t in enumerate(leaks)]
    want = by_definition(docs, items)
    assert all(any(i == 1000 + k for i, _ in want) for k in range(5 + 35))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limits in ({}, {"broadcast_items": 2}):
        got = {(x.doc_id, x.item_id): (x.n_tokens, x.n_equal, -x.doc_start) for x in d.overlaps(left, right, **limits).collect()}
        assert got == want, limits
        kept = {x.doc_id for x in d.drop_contaminated(left, right, **limits).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in want}
