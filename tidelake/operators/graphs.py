"""Orders and sums along dependencies: each node after all that it needs, and what is wrong with nodes that have no such place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators.storage import Scratch, ensure_checkpoint_dir

MISSING, CYCLE, BLOCKED = "missing parent", "cycle", "blocked"


def decode_layers(nodes: DataFrame, edges: DataFrame, node: str, child: str, parent: str) -> DataFrame:
    """(node, layer, fault), one row a different node: layer is the length of its longest chain of needs, null where fault is not.

    fault: "missing parent" if an own parent is no node; "cycle" if a node lies on a cycle,
    or between two; "blocked" if it only waits for such ones. Nodes and children are of one
    type that can be compared, structs too; edges of children that are no nodes do not count.
    Where no node has two parents, chains double in each round; else a layer is placed a round
    and its edges go, so that an edge is read once a layer up to its parent's.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    with Scratch(spark) as scratch:
        known = scratch.store(nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct())
        needs = scratch.store(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct().join(known, F.col("child") == F.col("node"), "left_semi"))
        single = needs.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        return (_chains if single else _peeled)(known, needs, scratch).withColumnRenamed("node", node).checkpoint()


def chain_sums(nodes: DataFrame, node: str, parent: str, size: str, name: str = "total") -> DataFrame:
    """(node, layer, fault, name) of nodes with one parent or none (null) each: the sum of `size` over a node and all before it; null where fault is not."""
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    with Scratch(spark) as scratch:
        known = scratch.store(nodes.select(F.col(node).alias("node"), F.col(size).alias("size"), F.col(parent).alias("parent")))
        needs = known.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent")
        out = _chains(known.select("node", "size"), needs, scratch)
        return out.select(F.col("node").alias(node), "layer", "fault", F.when(F.col("fault").isNull(), F.col("size")).alias(name)).checkpoint()


def _chains(known: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node points at its parent; in each round a pointer leaps as far again as it has come, so rounds follow the logarithm of the longest chain.

    Every round ends some chain that has an end; where none ends, all that are left have none.
    Once they have come as far as there are such nodes, their pointers stand on cycles, and
    every node of a cycle has one.
    """
    sized = "size" in known.columns
    carried = ["size"] if sized else []
    # Broadcasts would go through the driver anew in each round.
    parents = needs.join(known.select(F.col("node").alias("parent"), F.lit(True).alias("there")).hint("merge"), "parent", "left")
    begun = known.join(parents.withColumnRenamed("child", "node").hint("merge"), "node", "left")
    ending = F.when(F.col("parent").isNull(), "root").when(F.col("there").isNull(), MISSING)
    state = begun.select("node", *carried, F.when(ending.isNull(), F.col("parent")).alias("to"), F.when(ending.isNull(), 1).otherwise(0).cast("long").alias("steps"), ending.alias("ending"), (ending == MISSING).alias("own"))
    state = scratch.store(state)
    done, going, leap = state.where("ending IS NOT NULL"), scratch.store(state.where("ending IS NULL")), 1
    left, same = going.count(), False
    while left and not (same and leap >= left):
        ahead = done.unionByName(going).select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("ending").alias("end"), *[F.col(c).alias(f"more_{c}") for c in carried])
        both = going.drop("ending").join(ahead.hint("merge"), "to").select("node", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in carried], F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("ending"), "own")
        moved = scratch.store(both)
        done, going, leap = done.unionByName(moved.where("ending IS NOT NULL")), moved.where("ending IS NULL"), 2 * leap
        left, before = going.count(), left
        same = left == before
    loops = going.select(F.col("to").alias("node")).distinct().withColumn("looped", F.lit(True))
    endless = going.join(loops.hint("merge"), "node", "left").select("node", *carried, F.lit(None).cast("long").alias("layer"), F.when(F.col("looped"), CYCLE).otherwise(BLOCKED).alias("fault"))
    fault = F.when(F.col("ending") == MISSING, F.when(F.coalesce("own", F.lit(False)), MISSING).otherwise(BLOCKED))
    return done.select("node", *carried, F.when(fault.isNull(), F.col("steps")).alias("layer"), fault.alias("fault")).unionByName(endless)


def _peel(nodes: DataFrame, needs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, layer) of the nodes whose needs can be met one layer after the other, and the nodes that are left."""
    fresh = scratch.store(nodes.join(needs, nodes["node"] == needs["child"], "left_anti").select("node", F.lit(0).cast("long").alias("layer")))
    placed, layer = [fresh], 0
    while not fresh.isEmpty():
        layer += 1
        met = needs.join(fresh.select(F.col("node").alias("parent")), "parent", "left_semi")
        before, needs = needs, scratch.store(needs.join(fresh.select(F.col("node").alias("parent")), "parent", "left_anti"))
        fresh = scratch.store(met.select(F.col("child").alias("node")).distinct().join(needs.select(F.col("child").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer).cast("long")))
        if layer > 1:
            scratch.drop(before)
        placed.append(fresh)
    done = reduce(DataFrame.unionByName, placed)
    return done, scratch.store(nodes.join(done, "node", "left_anti"))


def _peeled(known: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    done, rest = _peel(known, needs, scratch)
    out = done.withColumn("fault", F.lit(None).cast("string"))
    if rest.isEmpty():
        return out
    within = lambda some: scratch.store(needs.join(some.select(F.col("node").alias("parent")), "parent", "left_semi").join(some.select(F.col("node").alias("child")), "child", "left_semi").select("child", "parent"))
    lacks = needs.join(known.select(F.col("node").alias("parent")), "parent", "left_anti").select(F.col("child").alias("node")).distinct().withColumn("lacks", F.lit(True))
    # What can be placed once missing parents are forgiven is behind those, what has no one waiting in turn is behind a cycle.
    _, turning = _peel(rest, within(rest), scratch)
    looped = turning
    if not turning.isEmpty():
        _, looped = _peel(turning, within(turning).select(F.col("child").alias("parent"), F.col("parent").alias("child")), scratch)
    marks = rest.join(lacks, "node", "left").join(looped.select("node", F.lit(True).alias("looped")), "node", "left")
    fault = F.when(F.col("lacks"), MISSING).when(F.col("looped"), CYCLE).otherwise(BLOCKED)
    return out.unionByName(marks.select("node", F.lit(None).cast("long").alias("layer"), fault.alias("fault")))
