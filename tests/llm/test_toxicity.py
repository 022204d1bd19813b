import random
import zlib

import numpy as np

from tidelake.llm import toxicity


def corpus(n=900):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = [r.choice(words) for _ in range(60)] + [r.choice(["vile", "Foul!", "nasty"]) for _ in range(3 * bad)]
        r.shuffle(text)
        rows.append((i, " ".join(text), i))
        if i % 7 < 3:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, 1), (5, "", 2)], "doc_id long, text string, score int")
    frame = spark.createDataFrame([*labels, (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, frame)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 2
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    hits = [r.predicted == (r.doc_id % 6 == 0) for r in got if r.held_out and texts.get(r.doc_id) and r.doc_id != 5]
    assert np.mean(hits) > 0.95
    # labels of held-out rows must not matter
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = toxicity.train(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert again.words == model.words and np.allclose(again.weights, model.weights)


def test_risk_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    x = (rng.random((60, 4)) < 0.4).astype(float)
    y = np.arange(60) < 15
    w, b = toxicity.fit(x, y, 0.3, steps=1500, rate=0.02, l2=0.05)

    def risk(w, b):
        z = x @ w + b
        loss = np.logaddexp(0, z)
        return 0.3 * np.logaddexp(0, -z[y]).mean() + max(0, loss[~y].mean() - 0.3 * loss[y].mean()) + 0.025 * (w @ w)

    best = risk(w, b)
    for _ in range(50):
        assert risk(w + rng.normal(0, 0.05, 4), b + rng.normal(0, 0.05)) > best - 1e-3


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 0
    one = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, predicted string")
    assert [r.predicted for r in toxicity.score(one, model).collect()] == [0]
    assert toxicity.drop_toxic(one, model).columns == ["doc_id", "text", "predicted"]
