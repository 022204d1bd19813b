"""Queries of joint oracles, policies and plans over the choices of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import planning as p
from tidelake.plans.selection import _BUDGETS, _CHOICES, _SELECT, _WALK, _budgeted, knapsack_dp, knapsack_fronts
from tidelake.registry import query

POLICIES = ("quality_proxy", "exact_error", "average_error")

_ORACLE = f"""{_WALK} SELECT region, feasible, CAST(cost AS BIGINT) AS cost, round(pooled, 6) AS pooled, array_to_string(selection, ',') AS selection FROM
(SELECT region, cost, utility / cost AS pooled, selection, count(*) OVER (PARTITION BY region) AS feasible, row_number() OVER (PARTITION BY region ORDER BY utility / cost, cost, selection) AS k FROM whole JOIN {_BUDGETS} USING (region) WHERE cost <= budget) WHERE k = 1"""


def _most(df: DataFrame) -> int:
    """Items of the case that has most: nations of a region."""
    return df.groupBy("region").agg(F.count_distinct("nation").alias("n")).agg(F.max("n")).first()[0] or 0


def _oracle(c: DataFrame) -> DataFrame:
    every = p.allocations(c.withColumn("n", F.col("cost")), "region", "nation", "choice", ["cost", "utility", "n"], _most(c))
    return p.joint_oracle(every, c.select("region", "budget").distinct(), "region", "cost", "utility", "n")


@query(_ORACLE)
def joint_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all allocations within a region's budget the one of least pooled balance a customer."""
    out = _oracle(_budgeted(spark, sf_dir))
    return out.select("region", "feasible", "cost", F.round("pooled", 6).alias("pooled"), F.array_join("selection", ",").alias("selection"))


@query(_SELECT)
def knapsack_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' segments by labels with dominance, feasibility and bounds."""
    out = p.select_by_labels(_budgeted(spark, sf_dir), "region", "nation", "choice", "cost", "utility", "budget")
    return out.select("region", "status", "utility", "cost", F.array_join("selection", ",").alias("selection"))


_SAMPLES = f"(SELECT region, nation, choice, cost, k AS sample, k + 1 AS weight, (nation * 7 + k * 3) % 5 + 1 AS area, utility AS quality, 2 * utility + 1000 * k AS base, utility * k + 1000 - choice AS own FROM {_CHOICES}, (VALUES (0), (1), (2)) v(k))"
_VALUES = {
    "quality_proxy": "quality",
    "exact_error": "base - own",
    "average_error": "avg(base) OVER (PARTITION BY region, nation, choice) - avg(own) OVER (PARTITION BY region, nation, choice)",
}
_AREAS = f"(SELECT region, sample, sum(area) AS areas FROM (SELECT DISTINCT region, sample, nation, area FROM {_SAMPLES}) GROUP BY ALL)"


def _policy_choices(policy: str) -> str:
    return f"(SELECT region, nation, choice, cost, sum(weight / 6 * (area / areas) * v) AS utility FROM (SELECT *, {_VALUES[policy]} AS v FROM {_SAMPLES}) JOIN {_AREAS} USING (region, sample) GROUP BY region, nation, choice, cost)"


def _decisions(policy: str) -> str:
    walk = _WALK.replace(_CHOICES, _policy_choices(policy))
    return f"""({walk} SELECT region, '{policy}' AS policy, utility, cost, selection FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY utility DESC, cost, selection) AS k FROM whole JOIN {_BUDGETS} USING (region) WHERE cost <= budget) WHERE k = 1)"""


def _by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, policy, status, utility, cost, selection of every policy."""
    c = _budgeted(spark, sf_dir)
    k, u = F.col("sample"), F.col("utility")
    samples = c.withColumn("sample", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    samples = samples.select("*", (k + 1).alias("weight"), ((F.col("nation") * 7 + k * 3) % 5 + 1).alias("area"), (2 * u + 1000 * k).alias("base"), (u * k + 1000 - F.col("choice")).alias("own"))
    parts = []
    for policy in POLICIES:
        worth = p.policy_utilities(samples, policy, "region", "sample", "weight", "nation", "choice", "area", "utility", "base", "own")
        priced = c.select("region", "nation", "choice", "cost", "budget").join(worth, ["region", "nation", "choice"])
        parts.append(p.select_by_labels(priced, "region", "nation", "choice", "cost", "utility", "budget").withColumn("policy", F.lit(policy)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" UNION ALL ".join(f"SELECT region, policy, CAST(cost AS BIGINT) AS cost, round(utility, 3) AS utility, array_to_string(selection, ',') AS selection FROM {_decisions(x)}" for x in POLICIES))
def policy_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' segments under three policies over samples with areas and weights."""
    return _by_policy(spark, sf_dir).select("region", "policy", "cost", F.round("utility", 3).alias("utility"), F.array_join("selection", ",").alias("selection"))


_POOLED = f"(SELECT region, policy, sum(u) / sum(c) AS pooled FROM (SELECT d.region, policy, r.utility AS u, r.cost AS c FROM ({' UNION ALL '.join(f'SELECT * FROM {_decisions(x)}' for x in POLICIES)}) d JOIN (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY nation) AS i FROM {_CHOICES}) r ON r.region = d.region AND r.choice = d.selection[r.i]) GROUP BY ALL)"


@query(f"SELECT region, policy, round(d.pooled, 6) AS pooled, round(greatest(d.pooled - o.pooled, 0), 6) AS gap FROM {_POOLED} d JOIN (SELECT region, pooled FROM (SELECT region, utility / cost AS pooled, row_number() OVER (PARTITION BY region ORDER BY utility / cost) AS k FROM ({_WALK} SELECT * FROM whole) JOIN {_BUDGETS} USING (region) WHERE cost <= budget) WHERE k = 1) o USING (region)")
def policy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each policy's allocation stays from the joint oracle in pooled balance a customer."""
    c = _budgeted(spark, sf_dir)
    place = c.select("region", "nation").distinct().groupBy("region").agg(F.array_sort(F.collect_list("nation")).alias("nations"))  # nations of a region: few
    decided = _by_policy(spark, sf_dir).drop("utility", "cost").join(place, "region").select("region", "policy", F.explode(F.arrays_zip("nations", "selection")).alias("d"))
    rows = decided.select("region", "policy", F.col("d.nations").alias("nation"), F.col("d.selection").alias("choice")).join(c, ["region", "nation", "choice"])
    pooled = rows.groupBy("region", "policy").agg((F.sum("utility") / F.sum("cost")).alias("pooled"))
    out = p.oracle_gap(pooled, _oracle(c), ["region"], "pooled")
    return out.select("region", "policy", F.round("pooled", 6).alias("pooled"), F.round("gap", 6).alias("gap"))


@query(f"SELECT region, 'same' AS verdict FROM ({_SELECT})")
def replayed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by dynamic programming against the same budgets decided again by fronts."""
    return p.replayed(knapsack_dp(spark, sf_dir), knapsack_fronts(spark, sf_dir), ["region"], ["status", "utility", "cost", "selection"])


_REST = f"(SELECT c.* FROM {_CHOICES} c JOIN (SELECT region, min(nation) AS first FROM {_CHOICES} GROUP BY region) f ON f.region = c.region AND nation > first)"
_ROOM = f"(SELECT region, budget - cost AS room FROM {_BUDGETS} JOIN (SELECT region, min_by(cost, nation) AS cost FROM {_CHOICES} WHERE choice = 0 GROUP BY region) USING (region))"


@query(f"""WITH plans AS (SELECT region, max(selection) AS selection FROM ({_WALK.replace(_CHOICES, _REST)} SELECT region, selection, row_number() OVER (PARTITION BY region ORDER BY utility DESC, selection) AS k FROM whole JOIN {_ROOM} USING (region) WHERE cost <= room) WHERE k = 1 GROUP BY region),
items AS (SELECT region, nation, min_by(choice, cost * 1000 + choice) AS cheap, dense_rank() OVER (PARTITION BY region ORDER BY nation) AS i FROM {_REST} GROUP BY region, nation)
SELECT region, nation, CAST(CASE WHEN selection IS NULL THEN cheap ELSE selection[i] END AS INTEGER) AS choice, CASE WHEN selection IS NULL THEN 'fallback' ELSE 'planned' END AS status, 2 AS clones FROM items LEFT JOIN plans USING (region)
UNION ALL SELECT region, min(nation), 0, CASE WHEN any_value(selection) IS NULL THEN 'fallback' ELSE 'planned' END, 2 FROM {_CHOICES} LEFT JOIN plans USING (region) GROUP BY region""")
def group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clones of each nation planned as one, the first nation of a region locked to its first segment, ten customers' worth a nation paid first."""
    c = _budgeted(spark, sf_dir)
    first = c.groupBy("region").agg(F.min("nation").alias("first"), (F.count_distinct("nation") * 10).alias("paid"))
    own = F.struct(F.concat_ws("-", "nation", "choice").alias("id"), F.col("cost").alias("bytes"))
    base = F.struct(F.concat(F.lit("base-"), F.col("nation")).alias("id"), F.lit(10).cast("long").alias("bytes"))
    rows = c.join(first, "region").withColumn("resources", F.array(base, own)).withColumn("budget", F.col("budget") + F.col("paid"))
    rows = rows.withColumn("locked", F.when(F.col("nation") == F.col("first"), 0)).withColumn("clone", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("item", F.concat_ws("-", "nation", "clone"))
    out = p.plan(rows.withColumn("weight", F.lit(1.0)), "region", "item", "choice", "weight", "utility", "resources", "locked", "budget")
    nation = F.substring_index("item", "-", 1).cast(dict(c.dtypes)["nation"]).alias("nation")
    return out.groupBy("region", nation, "choice", "status").agg(F.count("*").cast("int").alias("clones"))
