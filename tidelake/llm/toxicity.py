"""Toxicity: non-negative positive-unlabelled learning over word presence.

Confirmed toxic documents are the positives; all other training documents count
as unlabelled. The risk of calling unlabelled text clean is corrected by the
class prior, pi * R_p+ + max(0, R_u- - pi * R_p-), where the gradient turns once
the second part has fallen below zero by more than a slack (Kiryo et al., NeurIPS 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed_text

#: What is cut from both ends of a word before it is looked up.
EDGES = " .,;:!?\"'()[]{}*#$%&|<>-_"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def score(self, texts: Iterator[str]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        weight = dict(zip(self.words, self.weights.tolist(), strict=True))
        found = weight.keys()
        z = [self.bias + sum(weight[w] for w in distinct_words(t) & found) for t in texts]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def distinct_words(text: str) -> set[str]:
    return {w.strip(EDGES) for w in set(text.lower().split())}


def fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model under the non-negative risk, logistic loss, by Adam.

    The slack is the risk of calling every positive clean at even odds or so: sampling
    may put fewer positives into the unlabelled part than the prior says.
    """
    xp, xu = x[positive], x[~positive]
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    slack = prior
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sure = corrected >= -slack
        gp = -prior * (1 - sigmoid(zp)) / len(zp) * sure
        gu, turn = sigmoid(zu) / len(zu), 1.0 if sure else -1.0
        gp -= turn * prior * sigmoid(zp) / len(zp)
        gu *= turn
        g = np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000, max_words: int = 512, least: int = 4, clear: float = 5.0) -> Model:
    """A model from rows that are not held out.

    max_positive and max_unlabelled bound the training documents (those of least
    id hash); max_words bounds the words looked up, those in `least` positives or
    more whose share among positives is most clearly, and by `clear` standard
    errors at least, above that among unlabelled documents. The prior is the share
    of toxic labels among all labels that are not held out; an id labelled both ways
    counts as positive, and a null label or id is passed over. With no positives the
    model scores every text the prior (0.01 at least, also where there are no labels).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("doc_id")))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(toxic / n if n else 0.0, 0.01), 0.5)
    by_hash = lambda frame, limit: frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    confirmed = known.where("toxic = 1").select("doc_id").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().where(~held_out(F.col("doc_id"))).distinct()
    rest = by_hash(ids.join(confirmed, "doc_id", "left_anti"), max_unlabelled)
    sample = by_hash(confirmed, max_positive).withColumn("positive", F.lit(1)).unionByName(rest.withColumn("positive", F.lit(0)))
    text = keyed_text(docs).join(F.broadcast(sample), "doc_id")
    bounded_batches(docs.sparkSession)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "words": [sorted(distinct_words(t) - {""}) for t in batch["text"]]})

    bags = text.mapInPandas(words, "positive int, words array<string>").repartition(8).persist()
    try:
        n_pos, n_unl = bags.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.coalesce(F.sum(1 - F.col("positive")), F.lit(0))).first()
        if not n_pos or not n_unl:
            return Model((), np.zeros(0), float(np.log(prior / (1 - prior))))
        counts = bags.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
        share = (F.col("p") + F.col("u")) / (n_pos + n_unl)
        z = (F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl) + 1e-12)
        chosen = [r["word"] for r in counts.withColumn("z", z).where((F.col("p") >= least) & (F.col("z") >= clear)).orderBy(F.col("z").desc(), "word").limit(max_words).collect()]
        place = {w: k for k, w in enumerate(chosen)}

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"positive": batch["positive"], "at": [sorted(place[w] for w in ws if w in place) for ws in batch["words"]]})

        rows = sorted((r["positive"], tuple(r["at"])) for r in bags.mapInPandas(placed, "positive int, at array<int>").collect())
    finally:
        bags.unpersist()
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, (_, at) in enumerate(rows):
        x[k, list(at)] = 1
    weights, bias = fit(x, np.array([r[0] for r in rows]) == 1, prior)
    return Model(tuple(chosen), weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    A null or empty text has no words and scores the model's bias; a null id is
    not held out; rows that repeat give equal rows; other columns are not read. Very
    long texts are read whole.
    """
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(batch["text"])})

    out = keyed_text(docs).mapInPandas(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns stay as they are."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.fillna("")))

    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)
