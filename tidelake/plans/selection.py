"""Queries that weigh choices and select within budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import providers
from tidelake.operators import selection as s
from tidelake.registry import query
from tidelake.sources.tables import table

_CHOICES = """(SELECT n_regionkey AS region, n_nationkey AS nation, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY m) - 1 AS INTEGER) AS choice, cost, utility FROM
(SELECT n_regionkey, n_nationkey, c_mktsegment AS m, count(*) AS cost, CAST(round(sum(c_acctbal)) AS DOUBLE) AS utility FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL))"""
_BUDGETS = f"(SELECT region, CAST(sum(lo) + floor((sum(hi) - sum(lo)) * 0.5) AS BIGINT) AS budget FROM (SELECT region, nation, min(cost) AS lo, max(cost) AS hi FROM {_CHOICES} GROUP BY ALL) GROUP BY region)"


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each nation as choices: customers as cost, balance as utility; regions are the cases."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    sums = joined.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("cost"), F.round(F.sum("c_acctbal")).alias("utility"))
    return sums.withColumn("choice", F.row_number().over(Window.partitionBy("nation").orderBy("c_mktsegment")) - 1).drop("c_mktsegment")


#: Every allocation of every region, item by item.
_WALK = f"""WITH RECURSIVE ranked AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY nation) AS i FROM {_CHOICES}),
walk AS (SELECT region, i, cost, utility, [choice] AS selection FROM ranked WHERE i = 1 UNION ALL
SELECT r.region, r.i, w.cost + r.cost, w.utility + r.utility, list_append(w.selection, r.choice) FROM walk w JOIN ranked r ON r.region = w.region AND r.i = w.i + 1),
whole AS (SELECT walk.* FROM walk JOIN (SELECT region, max(i) AS i FROM ranked GROUP BY region) USING (region, i))"""
_SELECT = f"""{_WALK} SELECT region, 'optimal' AS status, utility, CAST(cost AS BIGINT) AS cost, array_to_string(selection, ',') AS selection FROM
(SELECT *, row_number() OVER (PARTITION BY region ORDER BY utility DESC, selection) AS k FROM whole JOIN {_BUDGETS} USING (region) WHERE cost <= budget) WHERE k = 1"""
_SHARED = f"""{_WALK} SELECT region, 'optimal' AS status, utility, CAST(cost AS BIGINT) AS cost, array_to_string(selection, ',') AS selection FROM
(SELECT *, row_number() OVER (PARTITION BY region ORDER BY utility DESC, cost, selection) AS k FROM (SELECT region, utility, selection, budget + 40 AS budget, cost + 40 * len(list_distinct(list_transform(selection, lambda c: c % 2))) AS cost
FROM whole JOIN {_BUDGETS} USING (region)) WHERE cost <= budget) WHERE k = 1"""


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = choices(spark, sf_dir)
    return c.join(s.budget_ladder(c, ["region"], "nation", "cost", [0.5]).select("region", "budget"), "region")


@query(_SELECT)
def knapsack_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment a nation within each region's budget, by dynamic programming."""
    out = s.select_within_budget(_budgeted(spark, sf_dir), "region", "nation", "choice", "cost", "utility", "budget")
    return out.select("region", "status", "utility", "cost", F.array_join("selection", ",").alias("selection"))


#: The same walk with costs in fortieths of the budget, rounded up and down.
_BRACKET = f"""WITH RECURSIVE ranked AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY nation) AS i, CAST((cost * 40 + budget - 1) // budget AS BIGINT) AS up, CAST(cost * 40 // budget AS BIGINT) AS down FROM {_CHOICES} JOIN {_BUDGETS} USING (region)),
walk AS (SELECT region, i, cost, utility, up, down FROM ranked WHERE i = 1 UNION ALL
SELECT DISTINCT r.region, r.i, w.cost + r.cost, w.utility + r.utility, w.up + r.up, w.down + r.down FROM walk w JOIN ranked r ON r.region = w.region AND r.i = w.i + 1),
whole AS (SELECT walk.*, budget FROM walk JOIN (SELECT region, max(i) AS i, max(budget) AS budget FROM ranked GROUP BY region) USING (region, i))"""


@query(f"""{_BRACKET} SELECT region, arg_max(utility, (utility, -cost)) FILTER (WHERE up <= 40) AS utility, CAST(arg_max(cost, (utility, -cost)) FILTER (WHERE up <= 40) AS BIGINT) AS cost, max(utility) FILTER (WHERE down <= 40) AS upper,
max(utility) FILTER (WHERE down <= 40) - max(utility) FILTER (WHERE up <= 40) AS gap, max(utility) FILTER (WHERE up <= 40) <= max(utility) FILTER (WHERE cost <= budget) AND max(utility) FILTER (WHERE cost <= budget) <= max(utility) FILTER (WHERE down <= 40) AS brackets FROM whole GROUP BY region""")
def knapsack_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's selection with the budget in forty parts, the bound above it, and whether the exact optimum lies between."""
    c = _budgeted(spark, sf_dir)
    rough = s.bounds_within_budget(c, "region", "nation", "choice", "cost", "utility", "budget", bins=40).drop("status", "selection")
    exact = s.select_within_budget(c, "region", "nation", "choice", "cost", "utility", "budget").select("region", F.col("utility").alias("exact"))
    return rough.join(exact, "region").select("region", "utility", "cost", "upper", "gap", F.col("exact").between(F.col("utility"), F.col("upper")).alias("brackets"))


@query(_SELECT)
def knapsack_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by fronts of spendings, as cases with very many bins are solved."""
    out = s.select_within_budget(_budgeted(spark, sf_dir), "region", "nation", "choice", "cost", "utility", "budget", max_cells=0)
    return out.select("region", "status", "utility", "cost", F.array_join("selection", ",").alias("selection"))


@query(_SELECT)
def knapsack_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by enumeration: the oracle of small cases."""
    c = _budgeted(spark, sf_dir)
    most = c.groupBy("region").agg(F.count_distinct("nation").alias("n")).agg(F.max("n")).first()[0] or 0
    out = s.enumerate_allocations(c, "region", "nation", "choice", "cost", "utility", "budget", most)
    return out.select("region", F.lit("optimal").alias("status"), "utility", "cost", F.array_join("selection", ",").alias("selection"))


@query(f"SELECT region, f AS fraction, CAST(lo + floor((hi - lo) * f) AS BIGINT) AS budget FROM (SELECT region, sum(lo) AS lo, sum(hi) AS hi FROM (SELECT region, nation, min(cost) AS lo, max(cost) AS hi FROM {_CHOICES} GROUP BY ALL) GROUP BY region), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(f)")
def budget_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.budget_ladder(choices(spark, sf_dir), ["region"], "nation", "cost", [0.25, 0.5, 0.75])


@query("SELECT p_partkey, round(p_size * (first_value(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - p_retailprice), 4) AS utility FROM part")
def weighted_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-weighted gain of each part over the first of its brand; negative gains stay."""
    p = table(spark, sf_dir, "part").withColumn("k", F.struct("p_size", "p_partkey"))
    return s.weighted_gain(p, ["p_brand"], "k", "p_retailprice", F.col("p_size")).select("p_partkey", F.round("utility", 4).alias("utility"))


_NAMED = {
    "share_quality": "coalesce(l_tax / nullif(l_quantity, 0) * l_discount, 0)",
    "visibility_psnr": "CASE WHEN l_tax > 0 THEN l_discount ELSE 0 END",
    "visibility_mse": "coalesce(l_tax / nullif(l_quantity, 0) * (50 - l_quantity), 0)",
    "solo_sse": "l_quantity * (50 - l_quantity)",
    "weighted_sse": "l_tax * (50 - l_quantity)",
    "historical_mse": "coalesce(sqrt(greatest(l_tax / nullif(l_quantity, 0), 0)) * (50 - l_quantity), 0)",
}


@query("SELECT l_returnflag, " + ", ".join(f"round(sum({e}), 3) AS {n}" for n, e in _NAMED.items()) + " FROM lineitem GROUP BY l_returnflag")
def named_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six objectives over the same rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("d0", F.lit(50.0))
    return rows.groupBy("l_returnflag").agg(*[F.round(F.sum(s.utility(n, "l_discount", "l_tax", "l_quantity", "d0", "l_quantity")), 3).alias(n) for n in _NAMED])


@query("SELECT c_custkey, CAST(ceil(c_acctbal / 250) AS BIGINT) AS cost_bins, CAST(floor(c_acctbal / 250) AS BIGINT) AS budget_bins, CAST(floor(CAST(c_acctbal AS DECIMAL(20, 4)) * CAST(0.9 AS DECIMAL(6, 4)) * 2 / 8) AS BIGINT) AS body_bytes FROM customer WHERE c_acctbal > 0".replace("* 2 / 8)", "* CAST(2 AS DECIMAL(10, 2)) / 8)"))
def discretised_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in bins upwards, budgets downwards, and the bytes that a rate carries in two seconds."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", s.discretised(b, 250).alias("cost_bins"), s.discretised(b, 250, False).alias("budget_bins"), s.budget_bytes(b, F.lit(2), 0.9).alias("body_bytes"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part WHERE p_retailprice <= 1500) WHERE k = 1")
def smallest_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest part of each brand within a price limit."""
    from tidelake.operators.relational import best

    return best(table(spark, sf_dir, "part").where("p_retailprice <= 1500"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query(f"SELECT region, CASE WHEN base > budget THEN 'fallback' ELSE 'planned' END AS status, CAST(greatest(base - budget, 0) AS BIGINT) AS overrun FROM (SELECT region, sum(cost) AS base FROM {_CHOICES} WHERE choice = 0 GROUP BY region) JOIN {_BUDGETS} USING (region)")
def base_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose first choices alone exceed the budget, and by how much."""
    base = _budgeted(spark, sf_dir).where("choice = 0").groupBy("region").agg(F.sum("cost").alias("base"), F.first("budget").alias("budget"))
    over = F.col("base") - F.col("budget")
    return base.select("region", F.when(over > 0, "fallback").otherwise("planned").alias("status"), F.greatest(over, F.lit(0)).alias("overrun"))


@query(_SHARED)
def shared_resource_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' choices where those of equal parity share a resource of forty customers' worth, within the budget and that once more."""
    c = _budgeted(spark, sf_dir)
    own = F.struct(F.concat_ws("-", "nation", "choice").alias("id"), F.col("cost").alias("bytes"))
    common = F.struct(F.concat(F.lit("common-"), F.col("choice") % 2).alias("id"), F.lit(40).cast("long").alias("bytes"))
    rows = c.withColumn("resources", F.array(own, common)).withColumn("budget", F.col("budget") + 40)
    out = s.select_with_shared_resources(rows, "region", "nation", "choice", "utility", "resources", "budget")
    return out.select("region", "status", "utility", "cost", F.array_join("selection", ",").alias("selection"))


_PROVIDED = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity END AS weight, l_linenumber - 1 AS visible, CAST(round(l_discount * 100) AS INT) AS pixels, l_extendedprice AS base, l_extendedprice / 7 AS own FROM {lineitem}"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN weight IS NULL OR pixels <= 0 THEN NULL WHEN visible <= 0 THEN 0 ELSE round(least(weight * visible / pixels * (base - own), 500000), 4) END AS value,
CASE WHEN weight IS NULL THEN 'missing weight' WHEN pixels <= 0 THEN 'no pixels' WHEN visible <= 0 THEN 'not visible' END AS reason FROM ({_PROVIDED.format(lineitem="lineitem")})""")
def provided_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density utilities of lines by a provider that SQL calls as a table function, with the reason where there is none."""
    rows = spark.sql(_PROVIDED, lineitem=table(spark, sf_dir, "lineitem"))
    providers.register(spark, "density_value", providers.Density(), rows.schema)
    out = spark.sql("SELECT * FROM density_value(TABLE(SELECT * FROM {rows}), most => 500000.0D)", rows=rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("value", 4).alias("value"), "reason")


@query("SELECT n_name, p_brand, round(sum(value), 2) AS value FROM (SELECT n_name, p_brand, greatest(count(*) * (max(l_discount) - avg(l_discount)), 0.5) AS value FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, p_brand) GROUP BY ALL")
def provided_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality gains of brands in nations by a provider, from SQL."""
    providers.register(spark, "quality_value", providers.Quality())
    names = {"lineitem": "l", "part": "p", "supplier": "s", "nation": "n"}
    t = {v: table(spark, sf_dir, k) for k, v in names.items()}
    rows = spark.sql("SELECT n_name, p_brand, count(*) AS seen, max(l_discount) AS base_error, avg(l_discount) AS error FROM {l} JOIN {p} ON p_partkey = l_partkey JOIN {s} ON s_suppkey = l_suppkey JOIN {n} ON n_nationkey = s_nationkey GROUP BY n_name, p_brand", **t)
    return spark.sql("SELECT n_name, p_brand, round(value, 2) AS value FROM quality_value(TABLE(SELECT * FROM {rows}), floor => 0.5D)", rows=rows)
