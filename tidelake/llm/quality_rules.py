"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

Sequential covering: grow a conjunction of threshold tests on two thirds of the
labelled statistics by information gain, prune it on the last third, keep it if
it is precise there, take away what it covers, and go on. The ordered list is
one CASE expression, which Spark evaluates inside the scan's own stage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, keyed_text, let

SYMBOLS = "#*$%&|<>"
#: What rules may test; each is a number for every text, 0 where its divisor is 0.
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "words_per_line")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def removed(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        found = F.transform(pairs, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.sort_array(F.filter(found, lambda i: i.isNotNull())), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), twice))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, windows)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and FEATURES of every whole text.

    Null text: as empty, all counts 0. Rows that repeat give rows that repeat.
    """
    base = keyed_text(docs, id_col, text_col)
    text = F.col("text")

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeat_words(words).alias("n_repeat_words"))

    def lined(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = base.select(
        "doc_id",
        let(words_of(text), counted).alias("w"),
        let(lines, lined).alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed(text, SYMBOLS).alias("n_symbols"),
        removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        removed(text, "0123456789").alias("n_digits"),
        removed(text, "!?;:()[]{}\"'/\\=+_~^@`").alias("n_marks"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_digits", "n_marks")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
            "digit_share": share("n_digits", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "words_per_line": share("n_words", "n_lines"),
        }
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.mask(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray, max_tests: int, cuts: int) -> Rule:
    """Adds the test of largest first-order gain until no good row is covered."""
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_tests and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        start, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, name in enumerate(FEATURES):
            values = x[inside, f]
            order = np.argsort(values, kind="stable")
            v, y = values[order], bad[inside][order]
            edges = np.flatnonzero(np.diff(v)) + 1
            if len(edges) > cuts:
                edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
            if not len(edges):
                continue
            low_p = np.concatenate([[0], np.cumsum(y)])[edges]
            for above, p, n in ((False, low_p, edges - low_p), (True, p0 - low_p, (len(v) - edges) - (p0 - low_p))):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - start), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], Test(name, above, float((v[edges[k] - 1] + v[edges[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].mask(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Cuts tests from the end while that does not lower (bad - good) / covered on rows that growing did not see."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / hit.sum() if hit.any() else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, max_rules: int = 12, max_tests: int = 3, cuts: int = 256, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """The ordered rules; fold 2 of 0, 1, 2 prunes and vets, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        growing, vetting = left & (fold != 2), left & (fold == 2)
        if (bad & growing).sum() < least:
            break
        rule = prune(grow(x[growing], bad[growing], max_tests, cuts), x[vetting], bad[vetting])
        hit = covers(rule, x) & left if rule else np.zeros(len(x), bool)
        right = [(hit & bad & part).sum() / max((hit & part).sum(), 1) for part in (growing, vetting)]
        if hit.sum() < least or right[0] < precision or (hit & vetting).any() and right[1] < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> list[Rule]:
    """Rules from at most max_rows labelled documents, those of least id hash.

    max_rows is the bound that lets the labelled sample be broadcast to the scan
    and its statistics (a few numbers a row) be fetched. Labels with a null id or
    a null quality are passed over. No labels, or labels of one kind: no rules. Where
    labelled ids repeat among docs, any 4 * max_rows of their rows are learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = (
        statistics(docs.select("doc_id", "text").join(F.broadcast(sample.select(F.col("doc_id").alias("labelled")).distinct()), F.col("doc_id") == F.col("labelled"), "left_semi"))
        .join(F.broadcast(sample), "doc_id")
        .select("quality", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *FEATURES)
        .limit(4 * max_rows)
        .collect()
    )
    if not rows:
        return []
    rows.sort(key=tuple)
    data = np.array(rows, float)
    return learn(data[:, 2:], data[:, 0] == 0, data[:, 1].astype(int), **options)


def rejected_by(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that a row meets, else 0: one CASE expression."""
    out = F
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for more in rule[1:]:
            test = test & more.column()
        out = out.when(test, F.lit(k))
    return F.lit(0) if out is F else out.otherwise(F.lit(0))


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rule (0: none) and kept for every document.

    An empty or null text fails the base. Ties and repeated rows are judged each
    by itself; extra columns of docs are not read.
    """
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return (
        statistics(docs, id_col, text_col)
        .withColumn("base_failed", (n < 50) | (100 * rep > 50 * n))
        .withColumn("rule", rejected_by(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
