"""Queries of fronts, overlaps, agreement of pairs, looped traces, and checks of profiles, protocols and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import metrics, relational, reports, temporal
from tidelake.plans.lookups import _BY_SUPPLIER, by_supplier
from tidelake.registry import query
from tidelake.sources.tables import table

_COUNTED = "(SELECT p_brand, p_partkey, p_retailprice, p_size, length(p_name) AS name FROM part)"


@query(f"SELECT p_partkey FROM {_COUNTED} a WHERE NOT EXISTS (SELECT 1 FROM {_COUNTED} b WHERE b.p_brand = a.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND b.name >= a.name AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size OR b.name > a.name))")
def pareto_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other of their brand beats on price, size and length of name together."""
    part = table(spark, sf_dir, "part").withColumn("name", F.length("p_name"))
    return relational.pareto_front(part, ["p_brand"], "p_retailprice", ["p_size", "name"]).select("p_partkey")


_BOXES = "(SELECT p_partkey AS id, p_size AS x, p_partkey / 100.0 AS y, p_retailprice AS z FROM part)"


@query(f"SELECT a.id AS a, b.id AS b FROM {_BOXES} a JOIN {_BOXES} b ON a.id < b.id AND a.x < b.x + 3 AND b.x < a.x + 3 AND a.y < b.y + 2 AND b.y < a.y + 2 AND a.z < b.z + 4 AND b.z < a.z + 4")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes, placed by size, key and price of parts, that overlap in all three directions."""
    p = table(spark, sf_dir, "part")
    low = {"x0": F.col("p_size"), "y0": F.col("p_partkey") / 100.0, "z0": F.col("p_retailprice")}
    boxes = p.withColumns(low).withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 2, "z1": F.col("z0") + 4})
    return relational.box_overlaps(boxes, "p_partkey", [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], 3.0)


@query(f"SELECT a.s_nationkey, count(*) AS pairs, round(avg(CASE WHEN a.q > b.q THEN 1.0 WHEN a.q = b.q THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM {_BY_SUPPLIER} a JOIN {_BY_SUPPLIER} b ON a.s_nationkey = b.s_nationkey AND a.v > b.v GROUP BY a.s_nationkey")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a nation's pairs of suppliers quantity puts in the order of revenue, ties half."""
    out = metrics.pairwise_accuracy(by_supplier(spark, sf_dir), ["s_nationkey"], "q", "v")
    return out.where("pairs > 0").select("s_nationkey", "pairs", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH s AS (SELECT h, coalesce(lead(h) OVER (ORDER BY h), 24) AS h1, r FROM (SELECT hour(ts) AS h, round(avg(value), 2) AS r FROM events WHERE event_type <> 'error' GROUP BY hour(ts))),
q AS (SELECT event_id, hour(ts) + minute(ts) / 60.0 AS a, hour(ts) + minute(ts) / 60.0 + value AS b FROM events)
SELECT event_id, round(sum((least(b, h1 + 24 * k) - greatest(a, h + 24 * k)) * r), 6) AS total FROM q JOIN range(0, 1000) t(k) ON 24 * k < b JOIN s ON least(b, h1 + 24 * k) > greatest(a, h + 24 * k) GROUP BY event_id""")
def looped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trace of rates by hour, which goes round each day, carries from each event's hour on for as many hours as its value."""
    e = table(spark, sf_dir, "events")
    steps = e.where("event_type <> 'error'").groupBy(F.hour("ts").alias("h")).agg(F.round(F.avg("value"), 2).alias("r"))
    spans = e.select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("a"), "value").withColumn("b", F.col("a") + F.col("value"))
    out = temporal.looped_integral(steps, "h", "r", 24.0, spans, "a", "b", "total")
    return out.where("b > a").select("event_id", F.round("total", 6).alias("total"))


@query("""SELECT user_id, frame, round(w0 + (frame * 25.0 - m0) / (m1 - m0) * (w1 - w0), 3) AS wall FROM (SELECT *, unnest(range(CAST(ceil(m0 / 25.0) AS BIGINT), CAST(ceil(m1 / 25.0) AS BIGINT))) AS frame FROM
(SELECT user_id, epoch_us(ts) / 1000000.0 AS w0, value AS m0, lead(epoch_us(ts) / 1000000.0) OVER w AS w1, lead(value) OVER w AS m1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE m1 > m0)""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each multiple of 25 in a user's rising values is passed."""
    e = table(spark, sf_dir, "events").withColumn("wall", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    return temporal.display_records(e, ["user_id"], "wall", "value", 25.0, "event_id").select("user_id", "frame", F.round("wall", 3).alias("wall"))


@query("""SELECT 'repeated key' AS rule, l_orderkey || ':' || l_linestatus AS key FROM lineitem GROUP BY l_orderkey, l_linestatus HAVING count(*) > 1 UNION ALL
SELECT 'bad error', l_orderkey || ':' || l_linestatus FROM lineitem WHERE l_discount - 0.01 < 0 UNION ALL
SELECT 'reference differs', l_orderkey || ':' || l_linestatus FROM lineitem WHERE l_linestatus = 'F' AND l_discount - 0.01 <> 0 UNION ALL
SELECT 'missing quality', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) < (SELECT count(DISTINCT l_linestatus) FROM lineitem)""")
def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts, line states as qualities: what such a profile breaks."""
    lines = table(spark, sf_dir, "lineitem").withColumn("error", F.col("l_discount") - 0.01)
    return reports.profile_faults(lines, ["l_orderkey"], "l_linestatus", "error", "F", ["l_orderkey", "l_linestatus"])


@query("""WITH d AS (SELECT n_regionkey, min(c_mktsegment) AS s, min(c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 4 GROUP BY n_regionkey),
r AS (SELECT n_regionkey, c_custkey, c_mktsegment AS s, c_custkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT r.n_regionkey, 's' AS field, r.s AS found, d.s AS wanted FROM r JOIN d USING (n_regionkey) WHERE r.s IS DISTINCT FROM d.s UNION ALL
SELECT r.n_regionkey, 'k', CAST(r.k AS VARCHAR), CAST(d.k AS VARCHAR) FROM r JOIN d USING (n_regionkey) WHERE r.k IS DISTINCT FROM d.k UNION ALL
SELECT r.n_regionkey, NULL, NULL, NULL FROM r WHERE n_regionkey NOT IN (SELECT n_regionkey FROM d)""")
def protocol_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held against their region's first segment and key; one region declares none."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = joined.select("n_regionkey", F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("k"))
    declared = rows.where("n_regionkey <> 4").groupBy("n_regionkey").agg(F.min("s").alias("s"), F.min("k").alias("k"))
    return reports.protocol_faults(rows, declared, ["n_regionkey"], ["s", "k"])


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'lines' WHEN last <> n OR places <> n THEN 'places' WHEN total <= 0 THEN 'total' WHEN shipped < o_orderdate THEN 'dates' WHEN o_orderstatus = 'F' AND open > 0 THEN 'state' END AS failed
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS places, sum(l_extendedprice) AS total, min(l_shipdate) AS shipped, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an order's checks that fails, in the order in which stages rely on them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"), F.count_distinct("l_linenumber").alias("places"), F.sum("l_extendedprice").alias("total"), F.min("l_shipdate").alias("shipped"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    gates = [("lines", F.col("n").isNotNull()), ("places", (F.col("last") == F.col("n")) & (F.col("places") == F.col("n"))), ("total", F.col("total") > 0), ("dates", F.col("shipped") >= F.col("o_orderdate")), ("state", (F.col("o_orderstatus") != "F") | (F.col("open") == 0))]
    return reports.first_failed(both, gates).select("o_orderkey", "failed")


@query("""SELECT k AS key, coalesce(a.v, b.v) AS v, CASE WHEN NOT coalesce(ina, false) THEN 'added' WHEN a.v IS NULL AND b.v IS NOT NULL THEN 'filled' ELSE 'stored' END AS origin
FROM (SELECT o_custkey AS k, round(max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS v, true AS ina FROM orders GROUP BY o_custkey) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer) b USING (k)""")
def backfilled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest settled order a customer, filled from balances where there is none."""
    top = F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    stored = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.round(top, 2).alias("v"))
    fresh = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    return relational.upsert(stored, fresh, ["key"], ["v"])


@query("""SELECT o_orderkey AS key FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders) FULL JOIN (SELECT l_orderkey AS o_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w FROM lineitem GROUP BY l_orderkey) USING (o_orderkey) WHERE v IS DISTINCT FROM w""")
def rebuilt_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose saved total is not what their lines add up to, either side lacking included."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    saved = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("v"))
    rebuilt = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    return reports.differing_rows(saved, rebuilt, ["key"], ["v"])


@query("""SELECT brand, budget, worst FROM (SELECT p_brand AS brand, min(p_size) AS lo, max(p_size) AS hi, unnest([0.25, 0.5, 0.75]) AS alpha, lo + CAST(floor(alpha * (hi - lo)) AS BIGINT) AS budget FROM part GROUP BY p_brand) JOIN LATERAL (SELECT max(p_retailprice) AS worst FROM part WHERE p_brand = brand AND p_size <= budget) ON true""")
def workload_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets at quarters between a brand's least and greatest size, and the dearest part that each admits."""
    p = table(spark, sf_dir, "part")
    ends = p.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    alpha = F.explode(F.array(*[F.lit(a) for a in (0.25, 0.5, 0.75)]))
    budgets = ends.withColumn("alpha", alpha).select("p_brand", (F.col("lo") + F.floor(F.col("alpha") * (F.col("hi") - F.col("lo")))).cast("long").alias("budget"), "alpha")
    fits = budgets.join(p, "p_brand").where(F.col("p_size") <= F.col("budget"))
    return fits.groupBy(F.col("p_brand").alias("brand"), "budget", "alpha").agg(F.max("p_retailprice").alias("worst")).drop("alpha")
