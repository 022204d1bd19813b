"""A corpus pipeline of five stages; each reads what the one before wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. Whole texts go through
all stages, however long; null and empty texts pass every filter but the near-duplicate
stage, which takes them for copies of each other. Of rows that repeat id and text one
passes that stage; the other stages treat each row by itself. Further columns go along,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import decontam, minhash, mixing, pii, toxicity
from tidelake.operators.storage import Scratch, ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of least doc_id."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no stretch of text with a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stretch="longest")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [EMAIL] and the like for personal data; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in a mixture of sources by the square root of their sizes."""
    return mixing.mix(docs, mixing.tempered_weights(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: Trained models are no matter for SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's result is written to the shared folder and read again, and goes once the next is written. The last one stays there, as the result reads it."""
    ensure_checkpoint_dir(spark)
    scratch = Scratch(spark)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES:
            before, docs = docs, scratch.store(stage(spark, docs, sf_dir))
            scratch.drop(before)
        return docs
    except BaseException:
        scratch.remove(scratch.folder)
        raise
