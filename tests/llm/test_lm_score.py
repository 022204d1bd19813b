import random
from collections import Counter

import numpy as np
import pytest

from tidelake.llm import lm_score as m
from tidelake.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def sentence(r):
    """Words follow each other by rule, so that neighbours tell a lot."""
    out, k = [], r.randrange(50)
    for _ in range(60):
        out.append(f"w{k}")
        k = (k * 3 + r.randrange(3)) % 50
    return out


def test_gradient_against_finite_differences():
    r = np.random.default_rng(0)
    net = m.Network.initial(r.integers(1, 100, m.IDS).astype(float))
    net = m.Network({k: v.astype(np.float64) for k, v in net.parts.items()})
    context, token = r.integers(0, m.IDS, (40, 4)), r.integers(1, m.IDS, 40)
    g = net.gradient(context, token)
    for name, at in (("embedding", (context[3, 1], 2)), ("gate", (2, 5)), ("shift", (3,)), ("class", (4, token[0] // m.CLASS)), ("class_bias", (1,)), ("member", (token[1] // m.CLASS, 3, token[1] % m.CLASS)), ("member_bias", (token[2] // m.CLASS, 7))):
        net.parts[name][at] += 1e-5
        up = net.log_probabilities(context, token).mean()
        net.parts[name][at] -= 2e-5
        down = net.log_probabilities(context, token).mean()
        net.parts[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, name


def test_probabilities_sum_to_one():
    net = m.Network.initial(np.arange(m.IDS, dtype=float))
    context = np.repeat([[5, 900, 0, 17]], m.IDS, 0)
    assert abs(np.exp(net.log_probabilities(context, np.arange(m.IDS))).sum() - 1) < 1e-4


def test_held_out_texts_score_above_shuffled_ones(spark, scratch):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(sentence(r)), "x") for i in range(600)], "doc_id long, text string, n_tokens string").repartition(4)
    model = m.fit(docs, scratch, rounds=2)
    assert model.totals.sum() == 600 * 60 and len(model.common) == 50
    held, mixed = [], []
    for i in range(40):
        words = sentence(r)
        held.append((i, " ".join(words)))
        r.shuffle(words)
        mixed.append((i, " ".join(words)))
    mean = lambda rows: {x.doc_id: x.mean_log_prob for x in m.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    a, b = mean(held), mean(mixed)
    assert np.mean([a[i] > b[i] for i in a]) > 0.95


def test_scores_against_one_place_at_a_time_and_edges(spark, scratch):
    r = random.Random(5)
    rare = [f"r{k}" for k in range(1500)]
    rows = [(1, "a b c d a"), (2, None), (3, ""), (4, "z"), (4, "z"), (None, "a a"), (6, "a b " * 9000)]
    rows += [(10 + k, " ".join(r.choices(rare, k=40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    model = m.fit(docs, scratch)
    ranked = sorted(counts.values(), reverse=True)
    assert len(model.common) == m.WORDS and model.totals[1 : 1 + m.WORDS].tolist() == ranked[: m.WORDS] and model.totals.sum() == sum(ranked)
    words = m.Vocabulary(model.common)
    word_of = {int(words.codes(w)[0]): w for w in counts}
    assert len(word_of) == len(counts)
    texts = dict(rows) | {99: "a r1 neverseen r2"}
    asked = spark.createDataFrame([*rows, (99, texts[99])], "doc_id long, text string")
    got = m.score(asked, model, batch_bytes=1000).collect()
    assert len(got) == len(rows) + 1
    for row in got:
        if row.doc_id == 6:
            assert row.n_tokens == 18000
            continue
        codes = words.codes(texts[row.doc_id] or "")
        ids = m.ids_of(codes)
        want = sum(float(model.network.log_probabilities(np.array([[ids[k + s] if 0 <= k + s < len(ids) else 0 for s in m.SIDES]]), ids[k : k + 1])[0]) for k in range(len(ids)))
        want += sum(np.log(counts.get(word_of.get(int(c)), 1) / max(model.totals[i], 1)) for c, i in zip(codes, ids) if c >= m.RARE)
        assert row.n_tokens == len(ids) and abs(row.log_prob - want) < 1e-3
        assert (row.mean_log_prob is None) == (not len(ids))
    empty = docs.limit(0)
    assert m.score(empty, m.fit(empty, scratch)).count() == 0


def test_shares_of_a_bucket_add_up_to_one(spark, scratch):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 7, 1500, 1 + k % 5))) for k in range(40)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    words = sorted({w for _, t in rows for w in t.split()})
    got = m.score(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), model).collect()
    unused = np.flatnonzero(model.totals[1:] == 0) + 1
    outside = np.exp(model.network.log_probabilities(np.zeros((len(unused) + 1, 4), np.int64), np.append(unused, 0))).sum()
    assert abs(sum(np.exp(g.log_prob) for g in got) + outside - 1) < 1e-3


def test_every_place_is_learned_from(spark, scratch):
    """What one place of a text tells of the next is learned in one pass, wherever it stands."""
    r = random.Random(4)
    pair = lambda: r.choice(["p r", "q s"])
    rows = [(i, f"{pair()} " + " ".join(r.choices("fg", k=5))) for i in range(20000)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), scratch)
    texts = [(1, "p r f f f g f"), (2, "p s f f f g f"), (3, "q s f f f g f"), (4, "q r f f f g f")]
    got = {x.doc_id: x.log_prob for x in m.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[1] - got[2] > 1 and got[3] - got[4] > 1


def test_words_are_those_of_split():
    texts = ["a b c  d", "", "  ", "x", "İstanbul ẞ \x1cq\x85z", "w" * 1_200_000 + " a"]
    codes, sizes = m.hashed(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert sizes.tolist() == [len(t.lower().split()) for t in texts]
    assert codes.tolist() == [m.code_of(w) for w in words] and len(set(codes.tolist())) == len(set(words))
