import random
import re

from tidelake.llm import substring_dedup as s


def brute(rows):
    """rows in order of (id, text); the definition, window by window."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(200)] + ["é", "a\x85b", "x\xa0y", "\x1cz"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = [some(n) for n in (19, 20, 21, 33, 60)]
    rows = []
    for i in range(90):
        words = some(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            at = r.randint(0, len(words))
            cut = r.randint(0, 3)
            words[at:at] = p[cut:]
        rows.append((r.randint(0, 10**6) * 3 + i % 3, r.choice([" ", "\n", "\t ", " \x0b"]).join(words)))
    rows += [(4, None), (5, ""), (6, " ".join(["a"] * 70)), (7, " ".join(["b", "c"] * 30)), (8, " ".join(passage[4])), (8, " ".join(passage[4])), (9, " ".join(passage[3] * 2)), (None, " ".join(passage[2])), (-5, " ".join(passage[1]))]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, batch int")
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    for size in (2 << 20, 1500):
        got = s.remove_repeats(frame, batch_bytes=size).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_cover_is_a_difference_cover():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
