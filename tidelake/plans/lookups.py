"""Queries of lookups, interpolations, validations and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import scalars
from tidelake.operators import metrics, relational, reports, temporal
from tidelake.registry import query
from tidelake.sources.tables import table

_BY_SUPPLIER = "(SELECT s_nationkey, s_suppkey, sum(l_quantity) AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and revenue in cents by nation and supplier."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy("s_nationkey", "s_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))


@query(f"SELECT s_nationkey, max(CASE WHEN k = 1 AND a = 1 THEN 1 ELSE 0 END) AS top_hit, round(count(*) FILTER (WHERE a <= 3 AND p <= 3) / count(*) FILTER (WHERE a <= 3), 6) AS recall FROM (SELECT s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY q DESC) AS p, rank() OVER (PARTITION BY s_nationkey ORDER BY v DESC) AS a, row_number() OVER (PARTITION BY s_nationkey ORDER BY q DESC, s_suppkey) AS k FROM {_BY_SUPPLIER}) GROUP BY s_nationkey")
def top_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quantity picks a nation's first supplier by revenue, and how many of its first three, ties included."""
    out = metrics.top_agreement(by_supplier(spark, sf_dir), ["s_nationkey"], "s_suppkey", "q", "v", 3)
    return out.select("s_nationkey", "top_hit", F.round("recall", 6).alias("recall"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS place FROM part")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each part's size within its brand, ties sharing the mean."""
    return metrics.ranks_by_value(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "place").select("p_partkey", "place")


@query("SELECT o_orderkey, round(coalesce(o_totalprice / nullif(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 0), 8) AS share FROM orders")
def shares_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's part of its customer's spending."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(metrics.share_of_total("o_totalprice", ["o_custkey"]), 8).alias("share"))


_NEAR = "(SELECT q.vec_id AS query, v.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"


@query(f"SELECT query, round(coalesce(avg(label) FILTER (WHERE d = 0), sum(label / (d * d)) FILTER (WHERE d > 0) / sum(1 / (d * d)) FILTER (WHERE d > 0)), 6) AS value FROM {_NEAR} WHERE k <= 16 GROUP BY query")
def inverse_distance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at the stated queries (ids divisible by 100) from their 16 nearest of all vectors, by inverse squared distance."""
    e = table(spark, sf_dir, "embeddings")
    near = relational.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 16)
    return relational.inverse_distance(near, e, "vec_id", "label", "value").select("query", F.round("value", 6).alias("value"))


_GRID = "(SELECT hour(ts) // 6 * 6 AS h, (day(ts) - 1) // 10 * 10 AS d, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


@query(f"""WITH g AS {_GRID}, q AS (SELECT event_id, hour(ts) + minute(ts) / 60.0 AS x, day(ts) - 1 AS y FROM events),
b AS (SELECT event_id, (SELECT max(h) FROM g WHERE h <= x) AS h0, (SELECT min(h) FROM g WHERE h > x) AS h1, (SELECT max(d) FROM g WHERE d <= y) AS d0, coalesce((SELECT min(d) FROM g WHERE d > y), (SELECT max(d) FROM g)) AS d1, x, y FROM q),
c AS (SELECT event_id, coalesce(h0, (SELECT max(h) FROM g)) AS h0, coalesce(h1, (SELECT min(h) FROM g)) AS h1, d0, d1, x, y FROM b),
w AS (SELECT *, CASE WHEN (h1 - h0 + 24) % 24 > 0 THEN ((x - h0 + 24) % 24) / ((h1 - h0 + 24) % 24) ELSE 0 END AS wh, CASE WHEN d1 > d0 THEN (y - d0) / (d1 - d0) ELSE 0 END AS wd FROM c)
SELECT event_id, round(sum(weight * v), 3) AS value FROM (SELECT event_id, h0 AS h, d0 AS d, (1 - wh) * (1 - wd) AS weight FROM w UNION ALL SELECT event_id, h1, d0, wh * (1 - wd) FROM w UNION ALL SELECT event_id, h0, d1, (1 - wh) * wd FROM w UNION ALL SELECT event_id, h1, d1, wh * wd FROM w) JOIN g USING (h, d) GROUP BY event_id""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value at each event's time of day, which goes round, and day of month, which ends, between the four grid points around it."""
    e = table(spark, sf_dir, "events")
    grid = e.groupBy((F.floor(F.hour("ts") / 6) * 6).cast("double").alias("h"), (F.floor((F.dayofmonth("ts") - 1) / 10) * 10).cast("double").alias("d")).agg(F.round(F.avg("value"), 6).alias("v"))
    points = e.select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"), (F.dayofmonth("ts") - 1).alias("y"))
    by_hour = relational.bracket(grid.select("h"), points, "x", 24.0).withColumnsRenamed({"lo": "h0", "hi": "h1", "w": "wh"})
    both = relational.bracket(grid.select("d"), by_hour, "y").withColumnsRenamed({"lo": "d0", "hi": "d1", "w": "wd"})
    corner = lambda h, d, w: F.struct(F.col(h).alias("h"), F.col(d).alias("d"), w.alias("weight"))
    wh, wd = F.col("wh"), F.col("wd")
    corners = F.explode(F.array(corner("h0", "d0", (1 - wh) * (1 - wd)), corner("h1", "d0", wh * (1 - wd)), corner("h0", "d1", (1 - wh) * wd), corner("h1", "d1", wh * wd)))
    rows = both.select("event_id", corners.alias("c")).select("event_id", "c.*").join(grid, ["h", "d"])
    return rows.groupBy("event_id").agg(F.round(F.sum(F.col("weight") * F.col("v")), 3).alias("value"))


@query("SELECT o_custkey, count(pa) AS n_a, count(pb) AS n_b, CAST(coalesce(min(CASE WHEN pa IS DISTINCT FROM pb THEN k END) - 1, count(pa)) AS BIGINT) AS shared FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderpriority AS pa FROM orders) FULL JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderpriority AS pb FROM orders WHERE o_orderstatus <> 'P') USING (o_custkey, k) GROUP BY o_custkey")
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the priorities of a customer's orders agree with those of a run that leaves pending orders out."""
    o = table(spark, sf_dir, "orders")
    return relational.shared_prefix(o, o.where("o_orderstatus <> 'P'"), ["o_custkey"], ["o_orderkey"], "o_orderpriority")


@query("SELECT p_brand, p_partkey, p_size FROM part WHERE p_size % 5 < 3 AND p_brand IN (SELECT p_brand FROM (SELECT p_brand, min(p_size) AS s FROM part GROUP BY p_brand) WHERE s % 5 < 3)")
def restricted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the allowed sizes, of brands whose base, the least size, is allowed."""
    p = table(spark, sf_dir, "part")
    allowed = table(spark, sf_dir, "part").select("p_size").distinct().where("p_size % 5 < 3")
    return reports.restricted(p, ["p_brand"], "p_size", allowed).select("p_brand", "p_partkey", "p_size")


@query("""SELECT 'repeated key' AS rule, l_orderkey || ':' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL
SELECT 'no source', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey UNION ALL
SELECT 'not covered', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL
SELECT 'places', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def package_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of lines breaks: unique keys, known sources, coverage, and places from 1 to n."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return reports.package_faults(lines, orders, "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS t, o_totalprice AS v FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS t, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 3 GROUP BY ALL)
SELECT t AS o_orderkey, v AS o_totalprice, n AS n_lines FROM a JOIN b USING (k, t) WHERE k NOT IN (SELECT k FROM a FULL JOIN b USING (k, t) WHERE v IS NULL OR n IS NULL)""")
def aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders side by side with their counts of larger lines, of customers who have the same orders in both series."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).join(o, "o_orderkey").select("o_custkey", "o_orderkey", "n")
    return relational.aligned(o, n, ["o_custkey"], ["o_orderkey"], "n", "n_lines").select("o_orderkey", "o_totalprice", "n_lines")


@query("SELECT event_id, CASE WHEN abs(value * 90 - round(value * 90)) < 1e-6 THEN CAST(round(value * 90) AS BIGINT) END AS ticks FROM events")
def frame_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as whole ticks of a clock of 90 a second; null where they fall between ticks."""
    return table(spark, sf_dir, "events").select("event_id", scalars.whole_ticks(F.col("value"), 90).alias("ticks"))


_W, _X, _Y, _Z = (f"({c} / sqrt(l_quantity ** 2 + l_tax ** 2 + l_discount ** 2 + l_linenumber ** 2))" for c in ("l_quantity", "l_tax", "l_discount", "l_linenumber"))


@query(f"SELECT l_orderkey, l_linenumber, round((1 - 2 * ({_Y} ** 2 + {_Z} ** 2)) + 2 * (2 * ({_X} * {_Y} - {_Z} * {_W})) + 3 * (2 * ({_X} * {_Z} + {_Y} * {_W})), 6) AS x FROM lineitem")
def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first coordinate of (1, 2, 3) turned by a quaternion of each line."""
    x, _, _ = scalars.rotated([F.lit(float(k)) for k in (1, 2, 3)], *[F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount", "l_linenumber")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"))


@query("SELECT user_id, round(sum(CASE WHEN playing THEN epoch_us(nxt) - epoch_us(ts) ELSE 0 END) / 1000000.0, 3) AS played_s FROM (SELECT user_id, ts, coalesce(last_value(CASE WHEN event_type = 'click' THEN true WHEN event_type = 'error' THEN false END IGNORE NULLS) OVER w, false) AS playing, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE nxt IS NOT NULL GROUP BY user_id")
def clock_play_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that a clock ran for each user: clicks start it, errors stop it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    switch = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", False)
    on = F.coalesce(F.last(switch, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumns({"on": on, "nxt": F.lead("ts").over(w)}).where("nxt is not null")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("on"), us("nxt") - us("ts")).otherwise(0)) / 1000000.0, 3).alias("played_s"))


@query("""
WITH t AS (SELECT o_orderkey AS batch, l_quantity AS q, l_returnflag = 'A' AS failed, greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE) - 3 * l_linenumber) AS a, CAST(l_shipdate AS DATE) AS z FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
busy AS (SELECT batch, sum(greatest(date_diff('day', CASE WHEN reach > a THEN reach ELSE a END, z), 0)) AS busy FROM (SELECT *, max(z) OVER (PARTITION BY batch ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WHERE z > a) GROUP BY batch)
SELECT batch, count(*) AS transfers, round(sum(q), 2) AS bytes, count(*) FILTER (WHERE failed) AS failed, CASE WHEN count(*) FILTER (WHERE failed) = 0 THEN round(sum(q) / max(busy), 6) END AS rate FROM t LEFT JOIN busy USING (batch) GROUP BY batch""")
def batch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as one batch of transfers, each three days a place long: a rate over the time that at least one of them took, none if one failed; bytes count in any case."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    rows = joined.select(F.col("o_orderkey").alias("batch"), "l_quantity", (F.col("l_returnflag") == "A").alias("bad"), F.greatest(day("o_orderdate"), day("l_shipdate") - 3 * F.col("l_linenumber")).alias("a"), day("l_shipdate").alias("z"))
    sums = rows.groupBy("batch").agg(F.count("*").alias("transfers"), F.round(F.sum("l_quantity"), 2).alias("bytes"), F.count_if("bad").alias("failed"))
    both = sums.join(temporal.interval_union(rows, ["batch"], "a", "z"), "batch", "left")
    return both.select("batch", "transfers", "bytes", "failed", F.when(F.col("failed") == 0, F.round(F.col("bytes") / F.col("busy"), 6)).alias("rate"))
