"""Running states of long series, by composing transitions.

A row's transition is a value that says what it does to any state; two transitions that
follow each other compose to one, and composing is associative. So a series is cut into
chunks of bounded size: each chunk composes its own transitions, the few chunks of a series
are scanned in the same way, and each chunk then runs from the state that it begins in. A
series of any length is spread over tasks, and nothing holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.storage import Scratch, ensure_checkpoint_dir

Compose = Callable[[Column, Column], Column]


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], scratch: Scratch, name: str = "__place") -> DataFrame:
    """df with each row's place in its series from 0; rows are dealt by ranges of (by, order), so that no series meets in one task."""
    dealt = scratch.store(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__ahead"))
    local = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    same = F.col("__part") == F.col("__of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    out = dealt.withColumn("__local", local).join(ahead, same)
    return out.withColumn(name, (F.col("__local") + F.col("__ahead")).cast("long")).drop("__part", "__of", "__local", "__ahead", *[f"__by{k}" for k in range(len(by))])


def composed_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], transition: str, compose: Compose, name: str, chunk: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """df with `name`: the composition of a series' transitions up to and with each row. order is full; compose(earlier, later) is of the transitions' own type."""
    spark = df.sparkSession
    if scratch is None:
        ensure_checkpoint_dir(spark)
        with Scratch(spark) as own:
            return composed_scan(df, by, order, transition, compose, name, chunk, own).checkpoint()
    rows = scratch.store(placed(df, by, order, scratch))
    return _scan(rows, by, transition, compose, name, chunk, scratch).select(*df.columns, name)


def _scan(rows: DataFrame, by: Sequence[str], transition: str, compose: Compose, name: str, chunk: int, scratch: Scratch) -> DataFrame:
    """rows, which have their __place, with name."""
    kind, rest = rows.schema[transition].dataType, [c for c in rows.columns if c not in by and c != "__place"]
    whole = rows.groupBy(*by, F.floor(F.col("__place") / chunk).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct("__place", *rest))).alias("__items"))
    # Running compositions of a chunk, the last of which is the chunk's own.
    begun = F.array(F.element_at("__items", 1)[transition])
    runs = F.aggregate(F.slice("__items", 2, F.size("__items")), begun, lambda done, x: F.concat(done, F.array(compose(F.element_at(done, -1), x[transition]).cast(kind))))
    chunks = scratch.store(whole.withColumn("__runs", runs))
    if chunks.where("__chunk > 0").isEmpty():
        ready = chunks.withColumn("__before", F.lit(None).cast(kind))
    else:
        ends = scratch.store(chunks.select(*by, F.col("__chunk").alias("__place"), F.element_at("__runs", -1).alias(transition)))
        scanned = _scan(ends, by, transition, compose, "__before", chunk, scratch)
        after = scanned.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], (F.col("__place") + 1).alias("__next"), "__before")
        same = F.col("__chunk") == F.col("__next")
        for k, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
        ready = chunks.join(after, same, "left")
    full = F.transform("__runs", lambda x: F.when(F.col("__before").isNull(), x).otherwise(compose(F.col("__before"), x).cast(kind)))
    out = ready.select(*by, F.explode(F.arrays_zip(F.col("__items").alias("item"), full.alias("run"))).alias("__x"))
    return out.select(*by, *[F.col(f"__x.item.{c}").alias(c) for c in ("__place", *rest)], F.col("__x.run").alias(name))
