import re

import numpy as np
from pyspark.sql import types as T

from tidelake.llm import quality_rules as q

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("kept", T.IntegerType())])


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "x x x x x x", "é# ü$  x y", "one two\none two\n\none two", "a\x0bb\x0cc\rd\x1ce", "w " * 300, " ".join(f"w{i % 97} v{i % 89}" for i in range(20000)), "<a>|b|&%*"]


def test_base_statistics_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(1, "", "clash", 1), (None, "a b", None, None)]
    got = q.apply_rules(spark.createDataFrame(rows, SCHEMA), []).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert all(r.kept == (not r.base_failed) for r in got)


def test_list_learns_planted_rule_and_spark_agrees(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"w{rng.integers(5000)}" for _ in range(80)) for _ in range(150)]
    bad = [" ".join(f"w{rng.integers(5000)}###" for _ in range(80)) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(240)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = q.learn_rules(docs, labels)
    assert rules
    kept = {r.doc_id: r.kept for r in q.apply_rules(docs, rules).collect()}
    assert all(kept[i] == (i < 150) for i in range(240))
    plan = q.apply_rules(docs, rules)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.learn_rules(docs, labels) == []
    assert q.apply_rules(docs, []).count() == 0
