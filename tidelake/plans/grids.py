"""Queries of interpolation on grids of many axes, of small grammars and of exact selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import scalars
from tidelake.operators import planning, relational
from tidelake.plans.selection import _BUDGETS, _WALK, _budgeted
from tidelake.registry import query
from tidelake.sources.tables import table

_AXES: dict[str, tuple[list[float], float | None]] = {
    "azimuth": ([0, 90, 180, 270], 360.0),
    "elevation": ([-20, 0, 20], None),
    "scale": ([1, 1.5, 2], None),
    "time": ([0, 5], None),
}
_POINTS = "(SELECT p_partkey, CAST(p_size * 13 % 360 AS DOUBLE) AS azimuth, CAST(p_size - 25 AS DOUBLE) AS elevation, p_retailprice / 1000 AS scale, CAST(p_partkey % 8 AS DOUBLE) AS time FROM part)"


def _ends(axis: str) -> str:
    """SQL of the two grid values around a point on an axis, and of the share of the upper one."""
    values, period = _AXES[axis]
    some = "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"
    low, high = f"list_max(list_filter({some}, lambda v: v <= {axis}))", f"list_min(list_filter({some}, lambda v: v > {axis}))"
    first, last = f"{values[0]}::DOUBLE", f"{values[-1]}::DOUBLE"
    lo, hi = f"coalesce({low}, {last if period else first})", f"coalesce({high}, {first if period else last})"
    turn = f" + {period}) % {period}" if period else ")"
    gap = f"(({hi} - {lo}){turn}" if period else f"({hi} - {lo})"
    part = f"(({axis} - {lo}){turn}" if period else f"({axis} - {lo})"
    return f"{lo} AS {axis}_0, {hi} AS {axis}_1, CASE WHEN {gap} > 0 THEN greatest({part}, 0) / ({gap}) ELSE 0 END AS {axis}_w"


_CORNER = ", ".join(f"CASE WHEN k_{a} = 0 THEN {a}_0 ELSE {a}_1 END AS {a}" for a in _AXES)
_WEIGHT = " * ".join(f"(CASE WHEN k_{a} = 0 THEN 1 - {a}_w ELSE {a}_w END)" for a in _AXES)
_BITS = ", ".join(f"(VALUES (0), (1)) b_{a}(k_{a})" for a in _AXES)
_VALUE = "CAST(CAST(azimuth * 7 + elevation * 3 + scale * 10 + time * 11 + 1000 AS BIGINT) % 17 AS DOUBLE)"


@query(f"SELECT p_partkey, round(sum(weight * {_VALUE}), 4) AS value FROM (SELECT p_partkey, {_CORNER}, {_WEIGHT} AS weight FROM (SELECT p_partkey, {', '.join(_ends(a) for a in _AXES)} FROM {_POINTS}), {_BITS}) GROUP BY p_partkey")
def view_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value between the sixteen grid points around each part, with a direction that goes round."""
    grid = spark.range(1)
    for a, (values, _) in _AXES.items():
        grid = grid.withColumn(a, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    grid = grid.withColumn("v", ((F.col("azimuth") * 7 + F.col("elevation") * 3 + F.col("scale") * 10 + F.col("time") * 11 + 1000).cast("long") % 17).cast("double"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 % 360).cast("double").alias("azimuth"), (F.col("p_size") - 25).cast("double").alias("elevation"), (F.col("p_retailprice") / 1000).alias("scale"), (F.col("p_partkey") % 8).cast("double").alias("time"))
    out = relational.interpolated(points, grid, "p_partkey", {a: period for a, (_, period) in _AXES.items()}, "v", "value")
    return out.select("p_partkey", F.round("value", 4).alias("value"))


@query("""SELECT p_partkey, CASE WHEN first <= last AND first < 1200 THEN first END AS first, CASE WHEN first <= last AND first < 1200 THEN last END AS last FROM (SELECT p_partkey,
CAST(CASE p_size % 4 WHEN 0 THEN greatest(1200 - p_size, 0) WHEN 1 THEN p_size WHEN 2 THEN p_size * 30 END AS BIGINT) AS first, CAST(CASE p_size % 4 WHEN 0 THEN 1199 WHEN 1 THEN 1199 WHEN 2 THEN least(p_size * 40, 1199) END AS BIGINT) AS last FROM part)""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a file of 1,200 bytes as headers ask for them: last bytes, from a byte on, from and to, and malformed."""
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    header = F.when(kind == 0, F.concat(F.lit("bytes=-"), size)).when(kind == 1, F.concat(F.lit("bytes="), size, F.lit("-"))).when(kind == 2, F.concat(F.lit("bytes="), F.col("p_size") * 30, F.lit("-"), F.col("p_size") * 40)).otherwise(F.concat(F.lit("bytes="), size))
    rows = table(spark, sf_dir, "part").select("p_partkey", scalars.byte_range(header, F.lit(1200).cast("long")).alias("r"))
    return rows.select("p_partkey", "r.first", "r.last")


@query("SELECT p_partkey, array_to_string(list_concat(range(p_size, p_size + 4), [p_size * 10]), ',') AS frames FROM part WHERE p_size > 0")
def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a text names as a range and a number."""
    p = table(spark, sf_dir, "part").where("p_size > 0")
    text = F.concat_ws("", F.col("p_size"), F.lit("-"), F.col("p_size") + 3, F.lit(", "), F.col("p_size") * 10)
    return p.select("p_partkey", F.array_join(scalars.frame_range(text), ",").alias("frames"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 >= 2 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 5 >= 4 THEN p_brand WHEN p_size % 5 = 3 THEN 'b=' || p_type END AS brand FROM part")
def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two options of argument lists that are cut short; one has two names and may be joined to its value."""
    words = F.array(F.lit("--size"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 3, F.concat(F.lit("-b=b="), F.col("p_type"))).otherwise("--brand"), F.col("p_brand"))
    given = F.slice(words, F.lit(1), F.col("p_size").cast("int") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.option_value(given, "--size").alias("size"), scalars.option_value(given, "--brand", "-b").alias("brand"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'price' WHEN p_size > 20 THEN 'brand' WHEN p_size > 10 THEN 'kind' END AS name, CASE WHEN p_size > 40 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) WHEN p_size > 20 THEN p_brand WHEN p_size > 10 THEN p_type END AS value FROM part")
def available_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a part's price, brand and kind that is there, by size."""
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(s > 40, F.floor("p_retailprice").cast("long")).alias("price"), F.when(s > 20, F.col("p_brand")).alias("brand"), F.when(s > 10, F.col("p_type")).alias("kind"))
    return rows.select("p_partkey", scalars.first_available("price", "brand", "kind").alias("f")).select("p_partkey", "f.name", "f.value")


_CELL = "CAST(sum(CASE WHEN (l_returnflag = 'R') = {} AND (l_linestatus = 'O') = {} THEN l_quantity ELSE 0 END) AS DOUBLE)"


@query(f"SELECT l_suppkey, {_CELL.format('true', 'true')} - {_CELL.format('true', 'false')} - {_CELL.format('false', 'true')} + {_CELL.format('false', 'false')} AS difference FROM lineitem GROUP BY l_suppkey")
def mixed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What return and open status do to a supplier's quantity together beyond what each does alone."""
    cell = lambda r, o: F.sum(F.when(((F.col("l_returnflag") == "R") == r) & ((F.col("l_linestatus") == "O") == o), F.col("l_quantity")).otherwise(0)).cast("double")
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(cell(False, False).alias("e00"), cell(True, False).alias("e10"), cell(False, True).alias("e01"), cell(True, True).alias("e11"))
    return cells.select("l_suppkey", scalars.mixed_difference(*[F.col(c) for c in ("e00", "e10", "e01", "e11")]).alias("difference"))


@query(f"""{_WALK} SELECT region, 'optimal' AS status, utility, CAST(cost AS BIGINT) AS cost, array_to_string(selection, ',') AS selection FROM
(SELECT *, row_number() OVER (PARTITION BY region ORDER BY utility DESC, cost, selection) AS k FROM whole JOIN {_BUDGETS} USING (region) WHERE cost <= budget) WHERE k = 1""")
def knapsack_exact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' segments by fronts of unrounded spendings, of equal utilities the cheaper: where labels are not to do."""
    out = planning.select_by_labels(_budgeted(spark, sf_dir), "region", "nation", "choice", "cost", "utility", "budget", max_labels=0)
    return out.select("region", "status", "utility", "cost", F.array_join("selection", ",").alias("selection"))
