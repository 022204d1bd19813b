"""Matrices of runs: what is left to do, audits of whole runs, frozen configurations, rates and layouts of what a run writes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells_of(axes: Sequence[DataFrame], most_cells: int = 10_000_000) -> DataFrame:
    """The product of a matrix's axes, each value once; a matrix of more cells than most_cells is refused before it is made."""
    axes = [axis.distinct() for axis in axes]
    size = math.prod(axis.count() for axis in axes)
    if size > most_cells:
        raise ValueError(f"a matrix of {size} cells")
    return reduce(DataFrame.crossJoin, axes)


def work_list(axes: Sequence[DataFrame], done: DataFrame, on: Sequence[str], most_cells: int = 10_000_000) -> DataFrame:
    """The cells of a matrix that are not done, once each; axes are the small tables that it is planned from."""
    return cells_of(axes, most_cells).select(*on).join(done.select(*on).distinct(), list(on), "left_anti")


def run_matrix(axes: Sequence[DataFrame], done: DataFrame, on: Sequence[str], build: Callable[[DataFrame], DataFrame], most_cells: int = 10_000_000) -> DataFrame:
    """Results of the whole matrix with origin: those done, and build() of the cells that are left. build() gives done's columns."""
    fresh = build(work_list(axes, done, on, most_cells)).select(*done.columns).withColumn("origin", F.lit("built"))
    kept = done.join(cells_of(axes, most_cells).select(*on), list(on), "left_semi").withColumn("origin", F.lit("done"))
    return kept.unionByName(fresh)


def run_faults(frames: DataFrame, totals: DataFrame, run: str, frame: str, size: Column, stated: str, tolerance: Column) -> DataFrame:
    """run, rule of what whole runs break: grid (frames are not 1 to n, once each), empty (no frame), unknown (frames of no run), total (sizes do not add up to those stated)."""
    seen = frames.groupBy(run).agg(F.count("*").alias("__n"), F.count_distinct(frame).alias("__d"), F.min(frame).alias("__lo"), F.max(frame).alias("__hi"), F.sum(size).alias("__sum"))
    both = totals.select(run, F.col(stated).alias("__stated"), F.lit(True).alias("__known")).join(seen, run, "full")
    there = F.col("__n").isNotNull()
    grid = there & ((F.col("__lo") != 1) | (F.col("__hi") != F.col("__n")) | (F.col("__d") != F.col("__n")))
    rules = {"grid": grid, "empty": ~there, "unknown": F.col("__known").isNull(), "total": there & (F.abs(F.col("__sum") - F.col("__stated")) > tolerance)}
    broken = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return both.select(run, F.explode(broken).alias("rule"))


def configuration_hash(inputs: DataFrame, by: Sequence[str], name: str, content: str, version: str) -> DataFrame:
    """by, inputs, configuration_hash: SHA-256 over the version and the names and content hashes of a configuration's inputs, in order of name.

    Inputs of a configuration are few. A name that comes twice is an error; null content hashes as nothing.
    """
    entry = F.concat(F.col(name).cast("string"), F.lit("="), F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))
    rows = inputs.groupBy(*by).agg(F.count("*").alias("inputs"), F.count_distinct(name).alias("__d"), F.array_sort(F.collect_list(entry)).alias("__e"))
    whole = F.sha2(F.concat_ws("\n", F.lit(version), F.array_join("__e", "\n")), 256)
    checked = F.when(F.col("__d") == F.col("inputs"), whole).otherwise(F.raise_error(F.lit("an input of a configuration comes twice")).cast("string"))
    return rows.select(*by, "inputs", checked.alias("configuration_hash"))


def representation_rates(segments: DataFrame, content: Sequence[str], rank: str, size: str, ticks: str, timescale: int) -> DataFrame:
    """content, rank, segments, peak_bps, mean_bps, required_bps of each representation.

    Peak: the greatest bits a second of its segments, upwards; mean over its whole time;
    required: the exact peaks of it and those of lower rank, added and then rounded upwards.
    Sizes and ticks are whole numbers and sums are decimals, so no rate is rounded early.
    """
    bits = (F.col(size) * 8 * timescale).cast("decimal(20,0)")
    exact = (bits / F.col(ticks).cast("decimal(12,0)")).cast("decimal(28,9)")
    rates = segments.groupBy(*content, rank).agg(
        F.count("*").alias("segments"),
        F.max(exact).alias("__peak"),
        F.ceil(F.sum(bits).cast("decimal(28,0)") / F.sum(F.col(ticks).cast("decimal(12,0)"))).cast("long").alias("mean_bps"),
    )
    upto = Window.partitionBy(*content).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return rates.select(*content, rank, "segments", F.ceil("__peak").cast("long").alias("peak_bps"), "mean_bps", F.ceil(F.sum("__peak").over(upto)).cast("long").alias("required_bps"))


def packed_segments(members: DataFrame, content: Sequence[str], frame: str, layer: str, size: str, group: int, header: int) -> DataFrame:
    """members with segment (frames in groups, a file a group and layer), refresh (its first frame needs none before it) and first_byte, last_byte in the file.

    Files begin with `header` bytes; members follow in order of frame, then size.
    """
    rows = members.withColumn("segment", F.floor((F.col(frame) - 1) / group).cast("long"))
    file = Window.partitionBy(*content, layer, "segment").orderBy(frame, size)
    before = F.coalesce(F.sum(size).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + header
    return rows.withColumn("refresh", F.row_number().over(file) == 1).withColumn("first_byte", before.cast("long")).withColumn("last_byte", (F.col("first_byte") + F.col(size) - 1).cast("long"))
