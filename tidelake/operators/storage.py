"""What operators need of a session: the shared folder, tables written there, arrays of a checked length, and row numbers over a whole table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Values that an array which goes to every task may have.
MOST_STEPS = 100_000


def bounded(array: str) -> Column:
    """An array column, or an error if it is longer than MOST_STEPS."""
    return F.when(F.size(array) <= MOST_STEPS, F.col(array)).otherwise(F.raise_error(F.concat(F.lit(f"more than {MOST_STEPS} steps: "), F.size(array).cast("string"))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster shares; where that is unset, a new one on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() writes to the folder that the cluster shares."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors; each goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove(self.folder)

    def remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def deal(self, df: DataFrame, by: str, buckets: int) -> DataFrame:
        """The table stored in buckets by hash of a column: joins, windows and groups by that column and others then shuffle nothing."""
        path, name = f"{self.folder}/{len(self.paths)}", f"dealt_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only; files of a given path stay
        self.paths.append((out, path))
        return out

    def keep(self) -> None:
        """Tables that a result still reads go when the session's process ends."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def drop(self, *frames: DataFrame) -> None:
        for out, path in self.paths:
            if any(out is f for f in frames):
                self.remove(path)


def global_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a full order: each range partition is numbered by itself and shifted by the counts before it."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn("__i", local).join(before, "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")
