"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal rows. Block k of a source
with weight w may run from slot floor(k / w) and must run before slot
ceil((k + 1) / w); earliest deadline first then gives each slot one block, and
at every slot each source has had its weight's share within less than one block
(Baruah et al., Algorithmica 1996). Weights are multiples of 1 / period, so the
schedule repeats every `period` slots: only one period is worked out, and every
block finds its slot in it by a join on (source, block modulo the source's part).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one part of a source, numbered together in one task.
PART_ROWS = 2000


def quantised(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole parts of `period` by largest remainder, 1 at least; sources of no weight are refused."""
    if not weights or min(weights.values()) <= 0 or len(weights) > period:
        raise ValueError("weights must be positive, and no more sources than slots in a period")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s)):
        if sum(parts.values()) < period:
            parts[s] += 1
    while (over := sum(parts.values()) - period) > 0:
        s = max(parts, key=lambda s: (parts[s], s))
        parts[s] -= min(over, parts[s] - 1)
    return parts


def schedule(parts: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, block of the period) of each slot of one period; ties go to the source that sorts first."""
    period = sum(parts.values())
    names, done, out = sorted(parts), dict.fromkeys(parts, 0), []
    for slot in range(period):
        ready = [s for s in names if done[s] < parts[s] and done[s] * period // parts[s] <= slot]
        best = min(ready, key=lambda s: -(-(done[s] + 1) * period // parts[s]))
        out.append((best, done[best]))
        done[best] += 1
    return out


def order_key(doc_id: Column) -> Column:
    """A fixed shuffle of ids: the first eight hex digits of the id's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def tempered_weights(docs: DataFrame, exponent: float = 0.5, max_sources: int = 1000) -> dict[str, float]:
    """Weight of each source: its rows to the power `exponent`. Raises beyond max_sources, which bounds what reaches the driver."""
    rows = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return {r["s"]: float(r["n"]) ** exponent for r in rows}


def mix(docs: DataFrame, weights: Mapping[str, float], block_rows: int = 64, period: int = 1000) -> DataFrame:
    """docs with mix_block, mix_slot, mix_place and mix_on_target; sort by mix_slot, mix_place for the mixture.

    All rows stay. mix_place counts rows in a block from 0. mix_on_target is true
    before the first slot that some source cannot fill with a whole block: up to
    there every source is within one block of its weight. Later slots that a used-up
    source would have had stay empty. A null source counts as "". Sources without a
    weight raise an error when rows of theirs are met. Rows with equal ids follow
    each other in any order; columns named mix_* in docs are replaced, others stay.
    Texts are moved and never read, however long.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_place", "mix_on_target")
    if not weights:
        return docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("mix_block", "long"), ("mix_slot", "long"), ("mix_place", "int"), ("mix_on_target", "boolean"))))
    spark = docs.sparkSession
    parts = quantised(weights, period)
    slots = spark.createDataFrame([(s, parts[s], k, t) for t, (s, k) in enumerate(schedule(parts))], "__s string, __n int, __k int, __t int")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    # Columns go by number from here on, so that their names cannot clash with those needed here.
    held = {f"__row{k}": name for k, name in enumerate(docs.columns)}
    keyed = docs.select("*", F.col("doc_id"), source, order_key(F.col("doc_id"))).toDF(*held, "__id", "__s", "__o")
    sizes = keyed.groupBy("__s").agg(F.count("*").alias("__rows")).withColumn("__cuts", F.ceil(F.col("__rows") / PART_ROWS))
    # The parts of a source are ranges of the order key, so that their offsets need only the parts' counts.
    cut = F.floor(F.col("__o") * F.col("__cuts") / F.lit(1 << 32)).cast("long")
    small = F.broadcast(sizes.select("__s", "__cuts"))  # one row a source, `period` at most
    placed = keyed.join(small, "__s").withColumn("__c", cut)
    before = (
        placed.groupBy("__s", "__c")
        .agg(F.count("*").alias("__m"))
        .withColumn("__before", F.sum("__m").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
        .select("__s", "__c", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    number = F.row_number().over(Window.partitionBy("__s", "__c").orderBy("__o", "__id")) - 1
    numbered = placed.withColumn("__i", number).join(before, ["__s", "__c"]).withColumn("__i", F.col("__i") + F.col("__before"))
    block = F.floor(F.col("__i") / block_rows)
    per_source = F.broadcast(slots.select("__s", "__n").distinct())
    whole = sizes.join(per_source, "__s").withColumn("__b", F.floor(F.col("__rows") / block_rows)).withColumn("__k", (F.col("__b") % F.col("__n")).cast("int"))
    at = lambda b: F.floor(F.col(b) / F.col("__n")) * period + F.col("__t")
    first_gap = whole.join(F.broadcast(slots.drop("__n")), ["__s", "__k"]).agg(F.min(at("__b"))).first()[0]
    known = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), F.col("__s")))).otherwise(F.col("__n"))
    out = (
        numbered.withColumn("mix_block", block)
        .join(per_source, "__s", "left")
        .withColumn("__k", (F.col("mix_block") % known).cast("int"))
        .join(F.broadcast(slots.drop("__n")), ["__s", "__k"])  # `period` rows
        .withColumn("mix_slot", at("mix_block"))
        .withColumn("mix_place", (F.col("__i") % block_rows).cast("int"))
        .withColumn("mix_on_target", F.col("mix_slot") < F.lit(first_gap if first_gap is not None else 0))
    )
    return out.select(*[F.col(k).alias(name) for k, name in held.items()], "mix_block", "mix_slot", "mix_place", "mix_on_target")


def oracle(block_rows: int = 64, period: int = 1000, exponent: float = 0.5) -> str:
    """DuckDB SQL for doc_id, source and the mix_ columns under tempered weights; the schedule is a recursive query."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS s, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS o FROM documents),
sizes AS (SELECT s, count(*) AS n FROM docs GROUP BY s),
exact AS (SELECT s, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * {period} AS x FROM sizes),
floors AS (SELECT *, greatest(1, CAST(floor(x) AS BIGINT)) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, s) AS r FROM exact),
parts AS (SELECT s, n, f + CASE WHEN r <= {period} - (SELECT sum(f) FROM floors) THEN 1 ELSE 0 END AS p FROM floors),
run AS (
  SELECT 0 AS slot, list_transform(list(p ORDER BY s), lambda x: 0) AS done, list(s ORDER BY s) AS names, list(p ORDER BY s) AS p, CAST(NULL AS BIGINT) AS pick FROM parts
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = pick_next THEN x + 1 ELSE x END), names, p, pick_next FROM (
    SELECT *, list_sort(list_transform(list_filter(range(1, len(p) + 1), lambda i: done[i] < p[i] AND done[i] * {period} // p[i] <= slot),
      lambda i: ((done[i] + 1) * {period} + p[i] - 1) // p[i] * 100000 + i))[1] % 100000 AS pick_next FROM run WHERE slot < {period})
),
slots AS (SELECT names[pick] AS s, done[pick] - 1 AS k, slot - 1 AS t FROM run WHERE slot > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1 AS i FROM docs),
gap AS (SELECT min(n // {block_rows} // p * {period} + t) AS g FROM parts JOIN slots USING (s) WHERE k = n // {block_rows} % p),
placed AS (SELECT doc_id, s, i // {block_rows} AS mix_block, i % {block_rows} AS place FROM numbered)
SELECT doc_id, s AS source, mix_block, mix_block // p * {period} + t AS mix_slot, CAST(place AS INTEGER) AS mix_place, mix_block // p * {period} + t < g AS mix_on_target
FROM placed JOIN parts USING (s) JOIN slots USING (s) CROSS JOIN gap WHERE k = mix_block % p"""
