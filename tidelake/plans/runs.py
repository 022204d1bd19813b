"""Queries of scenes, run matrices, audits and what packages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import runs, scenes
from tidelake.registry import query
from tidelake.sources.tables import table


@query("SELECT n_regionkey, n_nationkey, round(k - (n - 1) / 2, 6) AS line_x, round(cos(2 * pi() * k / n) * 3, 6) AS ring_x, round(sin(2 * pi() * k / n) * 2, 6) AS ring_z FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)")
def scene_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region on a line and around an ellipse."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    line = scenes.layout(n, ["n_regionkey"], "n_nationkey", "line").select("n_nationkey", F.round("x", 6).alias("line_x"))
    ring = scenes.layout(n, ["n_regionkey"], "n_nationkey", "circle").select("n_regionkey", "n_nationkey", F.round("x", 6).alias("ring_x"), F.round("z", 6).alias("ring_z"))
    return ring.join(line, "n_nationkey")


@query()
def scene_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region at random places at least 0.5 apart."""
    return scenes.placed(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", (-2.0, -1.0, -2.0), (2.0, 1.0, 2.0), 0.5, 7)


@query("SELECT o_orderkey, round(sin(2 * pi() * (o_orderkey % 250) / 250) * 30, 6) AS yaw FROM orders")
def camera_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a swinging camera is turned at each order's frame."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scenes.sine_yaw(F.col("o_orderkey"), 250, 30.0), 6).alias("yaw"))


_SEEN = "(SELECT p_partkey, p_retailprice / 1000 - 1.5 AS x, p_size / 50 - 0.5 AS y, p_size / 10 - 1 AS z, radians(p_size) AS t FROM part)"


@query(f"SELECT p_partkey, CASE WHEN depth > 0.01 THEN round(sx / depth * 300 + 319.5, 4) END AS u, CASE WHEN depth > 0.01 THEN round(y / depth * 300 + 239.5, 4) END AS v FROM (SELECT *, cos(t) * x + sin(t) * z AS sx, -sin(t) * x + cos(t) * z AS depth FROM {_SEEN})")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of parts as points before a turned camera; none behind it."""
    place = F.array(F.col("p_retailprice") / 1000 - 1.5, F.col("p_size") / 50 - 0.5, F.col("p_size") / 10 - 1)
    at = scenes.pixel(place, scenes.yaw_rows(F.col("p_size")), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), 300, 640, 480)
    rows = table(spark, sf_dir, "part").select("p_partkey", at.alias("at"))
    return rows.select("p_partkey", F.round("at.u", 4).alias("u"), F.round("at.v", 4).alias("v"))


#: Boxes before a camera that is turned by some degrees: near ones reach past the view, some lie behind it.
_BOX = "SELECT p_partkey, (p_partkey % 7) / 2.0 - 1.5 AS x, (p_size % 5) / 2.0 - 1 AS y, 1.0 - p_size / 8.0 AS z, 0.4 + (p_partkey % 3) * 0.7 AS h, radians(p_size % 11 * 7.0 - 35) AS t FROM {part}"
#: Clip coordinates of a point (px, py, pz): turned, then seen through a lens of near plane 1.
_CLIP = "[cos(t) * px + sin(t) * pz, 1.5 * py, -1.02 * (cos(t) * pz - sin(t) * px) - 2.02, sin(t) * px - cos(t) * pz]"


@query(f"""WITH RECURSIVE b AS ({_BOX.format(part="part")}),
sides AS (SELECT d, s, unnest(CASE WHEN s = 1 THEN [1, 2, 3, 4] ELSE [4, 3, 2, 1] END) AS corner, generate_subscripts([1, 2, 3, 4], 1) AS k FROM range(3) t(d), (VALUES (-1), (1)) u(s)),
corners AS (SELECT p_partkey, t, d, s, k, x + h * CASE d WHEN 0 THEN s WHEN 1 THEN b2 ELSE a2 END AS px, y + h * CASE d WHEN 1 THEN s WHEN 2 THEN b2 ELSE a2 END AS py, z + h * CASE d WHEN 2 THEN s WHEN 0 THEN b2 ELSE a2 END AS pz
  FROM b, (SELECT *, CASE WHEN corner IN (2, 3) THEN 1 ELSE -1 END AS a2, CASE WHEN corner IN (3, 4) THEN 1 ELSE -1 END AS b2 FROM sides)),
cut AS (
  SELECT p_partkey, d, s, 0 AS step, list({_CLIP} ORDER BY k) AS p FROM corners GROUP BY p_partkey, d, s
  UNION ALL
  SELECT p_partkey, d, s, step + 1, flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(
    CASE WHEN (e[i] >= 0) <> (e[(i + len(p) - 2) % len(p) + 1] >= 0) THEN [list_transform([1, 2, 3, 4], lambda c: p[(i + len(p) - 2) % len(p) + 1][c] + e[(i + len(p) - 2) % len(p) + 1] / (e[(i + len(p) - 2) % len(p) + 1] - e[i]) * (p[i][c] - p[(i + len(p) - 2) % len(p) + 1][c]))] ELSE [] END,
    CASE WHEN e[i] >= 0 THEN [p[i]] ELSE [] END)))
  FROM (SELECT *, list_transform(p, lambda q: q[4] + CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END * q[step // 2 + 1]) AS e FROM cut WHERE step < 6)),
area AS (SELECT p_partkey, greatest(coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] / p[i][4] * (p[i % len(p) + 1][2] / p[i % len(p) + 1][4]) - p[i % len(p) + 1][1] / p[i % len(p) + 1][4] * (p[i][2] / p[i][4]))), 0) / 2, 0) AS a FROM cut WHERE step = 6)
SELECT p_partkey, round(sum(a) * 640 * 480 / 4, 3) AS area FROM area GROUP BY p_partkey""")
def projected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of boxes before a turned camera, cut at the edges of its view."""
    b = spark.sql(_BOX, part=table(spark, sf_dir, "part"))
    low, high = (F.array(*[F.col(c).cast("double") + sign * F.col("h").cast("double") for c in "xyz"]) for sign in (-1, 1))
    c, s, none = F.cos("t"), F.sin("t"), F.lit(0.0)
    rows = F.array(F.array(c, none, s, none), F.array(none, F.lit(1.5), none, none), F.array(1.02 * s, none, -1.02 * c, F.lit(-2.02)), F.array(s, none, -c, none))
    return b.select("p_partkey", F.round(scenes.projected_area(low, high, rows, 640, 480), 3).alias("area"))


_LEFT = "(SELECT n_nationkey, o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P')"


def _axes(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """Nations and priorities as axes; cells with a pending order as done, with their orders."""
    orders = table(spark, sf_dir, "orders")
    pending = orders.where("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    done = pending.groupBy(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").agg(F.count("*").alias("n"))
    return [table(spark, sf_dir, "nation").select("n_nationkey"), orders.select("o_orderpriority").distinct()], done


@query("SELECT n_nationkey, o_orderpriority, month FROM nation, (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) EXCEPT SELECT c_nationkey, o_orderpriority, strftime(o_orderdate, '%Y-%m') FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def remaining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of nations, priorities and months without a pending order."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    done = orders.where("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("c_nationkey", "n_nationkey")
    axes = [table(spark, sf_dir, "nation").select("n_nationkey"), orders.select("o_orderpriority"), orders.select("month")]
    return runs.work_list(axes, done, ["n_nationkey", "o_orderpriority", "month"])


@query(f"SELECT c_nationkey AS n_nationkey, o_orderpriority, count(*) AS n, 'done' AS origin FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY ALL UNION ALL SELECT n_nationkey, o_orderpriority, count(o_orderkey), 'built' FROM {_LEFT} LEFT JOIN (SELECT c_nationkey AS n_nationkey, o_orderpriority, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey) USING (n_nationkey, o_orderpriority) GROUP BY ALL")
def matrix_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders of each cell where there are any, else all of its orders."""
    axes, done = _axes(spark, sf_dir)
    every = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority", "o_orderkey")

    def build(cells: DataFrame) -> DataFrame:
        return cells.join(every, ["n_nationkey", "o_orderpriority"], "left").groupBy("n_nationkey", "o_orderpriority").agg(F.count("o_orderkey").alias("n"))

    return runs.run_matrix(axes, done, ["n_nationkey", "o_orderpriority"], build)


_RUNS = "(SELECT coalesce(o_orderkey, l_orderkey) AS run, o_orderkey, o_totalprice, n, d, lo, hi, s FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS s FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"


@query(f"SELECT run, 'grid' AS rule FROM {_RUNS} WHERE n IS NOT NULL AND (lo <> 1 OR hi <> n OR d <> n) UNION ALL SELECT run, 'empty' FROM {_RUNS} WHERE n IS NULL UNION ALL SELECT run, 'unknown' FROM {_RUNS} WHERE o_orderkey IS NULL UNION ALL SELECT run, 'total' FROM {_RUNS} WHERE abs(s - CAST(o_totalprice AS DECIMAL(18, 2))) > 100000")
def run_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders audited as runs: their lines a grid, and their prices within 100,000 of what is stated."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), money("o_totalprice").alias("stated"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", money("l_extendedprice").alias("size"))
    return runs.run_faults(lines, orders, "run", "l_linenumber", F.col("size"), "stated", F.lit(100000))


@query("SELECT n_regionkey, count(*) AS inputs, sha256('v1' || chr(10) || string_agg(e, chr(10) ORDER BY e)) AS configuration_hash FROM (SELECT n_regionkey, n_nationkey || '=' || sha256(n_name) AS e FROM nation) GROUP BY n_regionkey")
def configuration_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions frozen as configurations whose inputs are nations."""
    return runs.configuration_hash(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", "n_name", "v1")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, segments, CAST(ceil(peak) AS BIGINT) AS peak_bps, mean_bps, CAST(ceil(sum(peak) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_linenumber)) AS BIGINT) AS required_bps FROM
(SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS segments, CAST(max(CAST(l_suppkey * 8 * 30 AS DOUBLE) / CAST(l_quantity AS BIGINT)) AS DECIMAL(28, 9)) AS peak, CAST(ceil(sum(CAST(l_suppkey * 8 * 30 AS BIGINT))::DOUBLE / sum(CAST(l_quantity AS BIGINT))) AS BIGINT) AS mean_bps FROM lineitem GROUP BY ALL)""")
def representation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments of suppkey bytes and quantity ticks; line numbers as layers."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ticks", F.col("l_quantity").cast("long"))
    return runs.representation_rates(rows, ["l_returnflag", "l_linestatus"], "l_linenumber", "l_suppkey", "ticks", 30)


@query("SELECT l_orderkey, l_linenumber, segment, k = 1 AS refresh, CAST(64 + upto - size AS BIGINT) AS first_byte, CAST(63 + upto AS BIGINT) AS last_byte FROM (SELECT *, row_number() OVER w AS k, sum(size) OVER w AS upto FROM (SELECT *, CAST(floor((l_linenumber - 1) / 3) AS BIGINT) AS segment, CAST(l_quantity AS BIGINT) AS size FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_returnflag, segment ORDER BY l_linenumber, size ROWS UNBOUNDED PRECEDING))")
def packed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed three a file by order and return flag, with their bytes in the file."""
    rows = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    return runs.packed_segments(rows, ["l_orderkey"], "l_linenumber", "l_returnflag", "size", 3, 64).select("l_orderkey", "l_linenumber", "segment", "refresh", "first_byte", "last_byte")
