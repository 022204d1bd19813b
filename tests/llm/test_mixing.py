from fractions import Fraction

import pytest

from tidelake.llm import mixing


def test_schedule_keeps_every_source_within_one_block():
    for weights in ({"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1.5, "d": 0.5}, {f"s{k}": k + 1 for k in range(20)}):
        parts = mixing.quantised(weights, 100)
        assert sum(parts.values()) == 100
        done = dict.fromkeys(parts, 0)
        for t, (s, k) in enumerate(mixing.schedule(parts)):
            assert k == done[s] and k * 100 // parts[s] <= t < -(-(k + 1) * 100 // parts[s])
            done[s] += 1
            assert all(abs(Fraction(parts[x] * (t + 1), 100) - done[x]) < 1 for x in parts)


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 7)
    rows = [(i, f"t{i}", "hot" if i % 3 else "cold" if i % 2 else None, "x") for i in range(200)] + [(5, "t5", "hot", "x")] * 3 + [(None, None, "cold", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot string")
    weights = {"hot": 2.0, "cold": 1.0, "": 1.0}
    got = mixing.mix(docs, weights, block_rows=4, period=8).collect()
    assert len(got) == len(rows)
    import hashlib

    parts = mixing.quantised(weights, 8)
    slot_of = {(s, k): t for t, (s, k) in enumerate(mixing.schedule(parts))}
    want, gaps = [], []
    for s in weights:
        key = lambda i: (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16), i is not None, i or 0)
        ids = sorted((r[0] for r in rows if (r[2] or "") == s), key=key)
        at = lambda b, s=s: b // parts[s] * 8 + slot_of[s, b % parts[s]]
        gaps.append(at(len(ids) // 4))
        want += [(i, s, n // 4, at(n // 4), n % 4) for n, i in enumerate(ids)]
    none = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted(((r.doc_id, r.source or "", r.mix_block, r.mix_slot, r.mix_place) for r in got), key=none) == sorted(want, key=none)
    assert all(r.mix_on_target == (r.mix_slot < min(gaps)) for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.quantised({"a": 0.0}, 10)
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs, {"b": 1.0}).collect()
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.tempered_weights(empty)).count() == 0
    assert mixing.mix(empty, {"a": 1.0}).count() == 0


def test_clashing_columns_stay(spark):
    rows = [(k, "t", f"s{k % 2}", k, -k, "own") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __s long, __i long, __row string")
    got = mixing.mix(docs, {"s0": 1.0, "s1": 2.0})
    assert got.columns[:6] == docs.columns and sorted(tuple(r)[:6] for r in got.collect()) == sorted(rows)
