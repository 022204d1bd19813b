"""What the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.storage import Scratch, ensure_checkpoint_dir, shared_folder

__all__ = ["SEPARATORS", "Scratch", "bounded_batches", "ensure_checkpoint_dir", "keyed_text", "let", "parts_by_size", "shared_folder", "table"]

#: Between words: space and the control characters 9 to 13.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, cannot clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def bounded_batches(spark: SparkSession) -> None:
    """Rows handed to Python at once, the same for every operator; parts_by_size() bounds what is worked on at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def parts_by_size(batch: pd.DataFrame, text: str = "text", chars: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """A batch in parts of at most so many characters; a longer text is a part by itself."""
    ends = np.cumsum(batch[text].str.len().fillna(0).to_numpy(np.int64))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chars, "right")))
        yield batch.iloc[a:b]
        a = b
