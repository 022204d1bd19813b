import random

import corpus_pipeline
from pyspark.sql import types as T
from tests.llm.test_decontam import brute as brute_overlaps
from tests.llm.test_minhash import brute_classes
from tidelake.llm import decontam, mixing, pii, toxicity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def corpus():
    r = random.Random(12)
    words = [f"w{k}" for k in range(900)]
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(5)]
    rows, labels = [], []
    for i in range(260):
        text = [r.choice(words) for _ in range(80)]
        if i % 8 == 0:
            for _ in range(4):
                text.insert(r.randrange(80), r.choice(["vile", "foul", "nasty"]))
        if i % 11 == 0:
            text[20:20] = items[i % 5][1].split()
        if i % 7 == 0:
            text[5:5] = ["mail", "someone@example.org", "now"]
        if i % 10 == 3 and rows:
            text = rows[-1][1].split()
            text[0] = "changed"
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        if r.random() < 0.7:
            labels.append((i, 1, int(i % 8 == 0)))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, rows[1][1], "en", "s1", 0)]
    return rows, labels, items


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    expected = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(SCHEMA.names)
        if name == "toxicity":
            model = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            expected = {i for i in before if model.score([text[i] or ""])[0] < 0.5}
            toxic = {i for i in range(260) if i % 8 == 0 and i % 10 != 3}
            assert len(toxic & set(after)) <= 0.1 * len(toxic)
            assert all(i in after for i in range(260) if i % 8 and i % 10 != 3)
        elif name == "near_duplicates":
            expected = set(brute_classes([(i, text[i]) for i in before]).values())
        elif name == "decontamination":
            expected = set(before) - {d for d, _ in brute_overlaps([(i, text[i]) for i in before], items)}
        else:
            expected = set(before)
        assert set(after) == expected, name
        if name == "pii":
            assert all(r.text is None or (not pii.base_spans(r.text) and r.n_chars == len(r.text)) for r in after.values())
            assert any("[EMAIL]" in (r.text or "") for r in after.values())
            assert all(r.text == text[i] for i, r in after.items() if "@" not in (text[i] or ""))
    parts = mixing.quantised(mixing.tempered_weights(docs), 1000)
    slot = {(s, k): t for t, (s, k) in enumerate(mixing.schedule(parts))}
    for r in docs.collect():
        s = r.source or ""
        assert r.mix_slot == r.mix_block // parts[s] * 1000 + slot[s, r.mix_block % parts[s]]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    assert decontam.MASKS
