"""Queries of summaries in time, of checks over catalogs and links, and of what choices cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import scalars
from tidelake.operators import graphs, metrics, planning, relational, reports, temporal
from tidelake.operators.selection import select_within_budget
from tidelake.plans.selection import _BUDGETS, _CHOICES, _SELECT, _budgeted
from tidelake.registry import query
from tidelake.sources.tables import table


def seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1000000.0


@query("""WITH t AS (SELECT l_partkey, l_suppkey, count(*) AS n, any_value(l_linenumber) AS line FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l_partkey, l_suppkey, CASE WHEN n = 1 THEN line END AS l_linenumber, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'ambiguous' END AS reason FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) LEFT JOIN t USING (l_partkey, l_suppkey)""")
def target_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned line of each part and supplier, none where there are several."""
    lines = table(spark, sf_dir, "lineitem")
    return relational.lookup_one(lines.select("l_partkey", "l_suppkey").distinct(), lines.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], ["l_linenumber"])


_FRAME = "SELECT o_orderpriority, power(CASE WHEN l_discount < 0.02 THEN 0 ELSE l_discount END, 2) AS e, CASE WHEN l_tax < 0.01 THEN 0 ELSE l_quantity END AS n, l_linenumber AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query(f"""SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (WHERE n > 0) AS n_measured, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS coverage, round(10 * log10(sum(n) / sum(e) FILTER (WHERE n > 0)), 6) AS psnr_db, round(avg(p), 6) AS mean_psnr_db,
round(sum(p * d) / sum(d) FILTER (WHERE p IS NOT NULL), 6) AS timed_psnr_db, round(sum(d) FILTER (WHERE n > 0) / sum(d), 6) AS time_coverage, count(*) FILTER (WHERE n > 0 AND e = 0) AS n_infinite
FROM (SELECT *, CASE WHEN n > 0 AND e > 0 THEN 10 * log10(n / e) END AS p FROM ({_FRAME})) GROUP BY o_orderpriority""")
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled, plain and time-weighted decibels of discounts as errors, with what was measured."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select("o_orderpriority", F.pow(F.when(F.col("l_discount") < 0.02, 0.0).otherwise(F.col("l_discount")), F.lit(2)).alias("e"), F.when(F.col("l_tax") < 0.01, 0.0).otherwise(F.col("l_quantity")).alias("n"), F.col("l_linenumber").alias("d"))
    out = metrics.frame_summary(rows, ["o_orderpriority"], "e", "n", "d")
    return out.select("o_orderpriority", "n_rows", "n_measured", *[F.round(c, 6).alias(c) for c in ("coverage", "psnr_db", "mean_psnr_db", "timed_psnr_db", "time_coverage")], "n_infinite")


@query("""SELECT user_id, f AS duration_from, count(*) AS n, round(sum(CASE f WHEN 'explicit' THEN value ELSE coalesce(gap, 1 / 30.0) END), 3) AS seconds FROM
(SELECT user_id, value, gap, CASE WHEN event_type = 'view' THEN 'explicit' WHEN gap IS NOT NULL THEN 'next' ELSE 'rate' END AS f FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 AS gap FROM events)) GROUP BY user_id, f""")
def sample_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long events hold: views by their value, others until the next one, the last for a thirtieth of a second."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("t"), F.when(F.col("event_type") == "view", F.col("value")).alias("own"))
    out = temporal.sample_durations(e, ["user_id"], "t", "event_id", "own", 30.0)
    return out.groupBy("user_id", "duration_from").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 3).alias("seconds"))


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t, coalesce(bool_or(event_type = 'view') OVER w, false) AS seen, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w, 0) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT user_id, k, arg_min(t, (t, event_id)) FILTER (WHERE event_type = 'error') AS s, arg_min(seen, (t, event_id)) FILTER (WHERE event_type = 'error') AS seen, min(t) FILTER (WHERE event_type = 'click') AS z FROM e WHERE event_type IN ('error', 'click') GROUP BY user_id, k)
SELECT user_id, CASE WHEN NOT seen THEN 'startup' WHEN s % 3600 <= 300 OR s % 3600 >= 3300 THEN 'boundary' ELSE 'feature' END AS cause, count(*) AS stalls, round(sum(z - s), 3) AS seconds FROM p WHERE s IS NOT NULL AND z IS NOT NULL GROUP BY ALL""")
def stall_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's stalls, from an error to the next click, by what they began at: before a view, near a full hour, or elsewhere."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("t"))
    out = temporal.stall_pairs(e, ["user_id"], "t", "event_id", "event_type", "error", "click", "view", 3600.0, 300.0)
    return out.groupBy("user_id", "cause").agg(F.count("*").alias("stalls"), F.round(F.sum("stalled"), 3).alias("seconds"))


@query("""WITH t AS (SELECT conv_id, turn, any_value(role) AS role, max(length(text)) AS payload, 24 AS header FROM conversations GROUP BY conv_id, turn),
c AS (SELECT *, sum(payload + header) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS gap FROM t)
SELECT role, count(*) AS turns, CAST(sum(payload) AS BIGINT) AS payload, CAST(sum(header) AS BIGINT) AS header, CAST(sum(CASE WHEN gap = 0 THEN total END) AS BIGINT) AS closure FROM c GROUP BY role""")
def closure_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of turns by role, of headers of 24 each, and of all that must be read to read a turn: itself and every turn before it."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.max(F.length("text")).alias("payload"))
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    rows = t.select(node(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("up"), (F.col("payload") + 24).cast("long").alias("size"))
    sums = graphs.chain_sums(rows, "node", "up", "size").select("node.conv_id", "node.turn", "total")
    return t.join(sums, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("turns"), F.sum("payload").cast("long").alias("payload"), (F.count("*") * 24).alias("header"), F.sum("total").alias("closure"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM events, range(0, 4) r(k) GROUP BY 1),
k AS (SELECT *, CASE WHEN mean <= (SELECT quantile_cont(mean, 0.1) FROM w) THEN 'low' WHEN mean >= (SELECT quantile_cont(mean, 0.9) FROM w) THEN 'high' ELSE 'middle' END AS kind FROM w),
f AS (SELECT kind, median(mean) AS mm, quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25) AS mr, median(variance) AS vm, quantile_cont(variance, 0.75) - quantile_cont(variance, 0.25) AS vr FROM k GROUP BY kind)
SELECT kind, start, n, round(mean, 6) AS mean, round(variance, 4) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(abs(mean - mm) / CASE WHEN mr > 0 THEN mr ELSE 1 END + abs(variance - vm) / CASE WHEN vr > 0 THEN vr ELSE 1 END, 9), start) AS i FROM k JOIN f USING (kind)) WHERE i = 1""")
def window_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day-long window, every six hours, that best stands for low, middle and high means."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "6 hours")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    rows = w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "mean", "variance")
    return reports.window_picks(rows, "mean", "variance").withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


_TURN = "SELECT p_partkey, radians(p_size) AS t, 1 + p_size / 10.0 AS s, CASE WHEN p_partkey % 4 = 1 THEN 0.01 ELSE 0 END AS shear, CASE WHEN p_partkey % 4 = 2 THEN -1 ELSE 1 END AS mirror FROM {part}"


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 NOT IN (1, 2) THEN round(1 + p_size / 10.0, 6) END AS scale FROM part")
def rigid_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of matrices that turn and scale; none of those that shear or mirror."""
    m = spark.sql(_TURN, part=table(spark, sf_dir, "part"))
    c, s, z = F.cos("t") * F.col("s"), F.sin("t") * F.col("s"), F.lit(0.0)
    rows = F.array(F.array(c, F.col("shear").cast("double"), s), F.array(z, F.col("mirror") * F.col("s").cast("double"), z), F.array(-s, z, c))
    return m.select("p_partkey", F.round(scalars.similarity_scale(rows), 6).alias("scale"))


@query("""WITH s AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 100 - (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 * 120 AS over FROM events WHERE event_type <> 'error')
SELECT user_id, event_id, round(over, 4) AS over FROM s WHERE over > 0.001""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events by whose time more value has come than a link of 120 a day, with 100 at once, could bring."""
    e = table(spark, sf_dir, "events").where("event_type != 'error'")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 86400000000.0
    out = reports.conservation_faults(e.withColumn("room", 100 + days * 120), ["user_id"], "ts", "event_id", "value", "room", 0.001)
    return out.select("user_id", "event_id", F.round("over", 4).alias("over"))


_NEED = "SELECT s_nationkey AS owner, l_returnflag AS choice, CASE WHEN l_linenumber < 5 THEN concat_ws('-', s_nationkey, l_partkey % 50) ELSE concat('p', l_partkey) END AS key, CASE WHEN l_linenumber < 5 THEN l_partkey % 50 + CASE WHEN l_tax > 0.075 AND l_partkey % 50 = 7 THEN 1 ELSE 0 END ELSE 9 END AS size FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_linenumber < 5 OR s_nationkey % 3 = 0"


@query(f"""WITH w AS ({_NEED.format(lineitem="lineitem", supplier="supplier")}), f AS (SELECT key, count(DISTINCT owner) > 1 AS shared, count(DISTINCT size) > 1 AS differs FROM w GROUP BY key),
g AS (SELECT owner, choice, key, max(size) AS s FROM w GROUP BY ALL)
SELECT owner, choice, CAST(CASE WHEN NOT bool_or(shared) AND NOT bool_or(differs) THEN sum(CASE WHEN key LIKE '%-3' THEN 0 ELSE s END) END AS BIGINT) AS missing_bytes, CASE WHEN bool_or(shared) THEN 'shared' WHEN bool_or(differs) THEN 'size differs' END AS reason FROM g JOIN f USING (key) GROUP BY owner, choice""")
def owned_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation's choices lack, unless a resource is another nation's too or has two sizes."""
    w = spark.sql(_NEED, lineitem=table(spark, sf_dir, "lineitem"), supplier=table(spark, sf_dir, "supplier"))
    return reports.owned_bytes(w, w.where("key LIKE '%-3'"), "owner", "choice", "key", "size").withColumn("missing_bytes", F.col("missing_bytes").cast("long"))


_LOSS = "SELECT l_partkey % 20 AS part, l_suppkey % 5 AS variant, l_linestatus AS prefix, avg(l_discount) AS mean, max(l_discount) AS worst, CAST(count(*) AS BIGINT) AS size FROM {lineitem} GROUP BY l_partkey % 20, l_suppkey % 5, l_linestatus"


@query(f"""WITH r AS ({_LOSS.format(lineitem="lineitem")}), v AS (SELECT part, variant, bool_and(mean <= 0.051 AND worst <= 0.25) AS ok, count(DISTINCT prefix) AS n, max(size) AS size FROM r GROUP BY ALL),
g AS (SELECT v.*, row_number() OVER (PARTITION BY part ORDER BY size, variant) AS k, min(size) OVER (PARTITION BY part) AS least FROM v JOIN (SELECT part, count(DISTINCT prefix) AS a FROM r GROUP BY part) USING (part) WHERE ok AND n = a)
SELECT part, max(CASE WHEN k = 1 THEN variant END) AS variant, max(CASE WHEN k = 1 THEN size END) AS size, count(*) FILTER (WHERE size <= least * 1.1) - 1 AS near_variants FROM g GROUP BY part""")
def smallest_that_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest variant of each part whose losses hold under both prefixes, and how many others are about as small."""
    return reports.smallest_that_hold(spark.sql(_LOSS, lineitem=table(spark, sf_dir, "lineitem")), ["part"], "variant", "prefix", "mean", "worst", "size", 0.051, 0.25, 0.1)


_CATALOG = "SELECT o_custkey AS content, o_orderstatus AS variant, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE 1 END AS place, o_custkey % 7 AS mapping, CASE WHEN o_totalprice > 400000 THEN 25 ELSE 30 END AS rate, CASE WHEN o_orderpriority = '5-LOW' THEN 0.21 ELSE 0.2 END AS length FROM {orders}"


@query(f"""WITH r AS ({_CATALOG.format(orders="orders")}), p AS (SELECT content, variant, min(place) AS lo, max(place) AS hi, count(DISTINCT place) AS d, count(*) AS n, count(DISTINCT rate) AS rates FROM r GROUP BY ALL)
SELECT 'places' AS rule, content || ':' || variant AS key FROM p WHERE lo <> 0 OR hi <> n - 1 OR d <> n UNION ALL
SELECT 'mapping', content || ':' || place FROM (SELECT content, place, count(DISTINCT mapping) AS m, count(DISTINCT variant) AS h FROM r GROUP BY ALL) JOIN (SELECT content, count(DISTINCT variant) AS v FROM r GROUP BY content) USING (content) WHERE m <> 1 OR h <> v UNION ALL
SELECT 'rate', content || ':' || variant FROM p WHERE rates <> 1 UNION ALL SELECT DISTINCT 'whole frames', content || ':' || variant || ':' || place FROM r WHERE abs(length * rate - round(length * rate)) > 1e-6""")
def catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' orders break as a catalog of variants: places, equal mappings, one rate, whole frames."""
    rows = spark.sql(_CATALOG, orders=table(spark, sf_dir, "orders"))
    return reports.catalog_faults(rows.withColumns({"length": F.col("length").cast("double")}), "content", "variant", "place", "mapping", "rate", "length")


@query(f"""WITH s AS ({_SELECT}), n AS (SELECT region, nation, row_number() OVER (PARTITION BY region ORDER BY nation) AS i FROM (SELECT DISTINCT region, nation FROM {_CHOICES})),
c AS (SELECT s.region, n.nation, CAST(string_split(selection, ',')[i] AS INTEGER) AS choice FROM s JOIN n USING (region))
SELECT region, CAST(sum(cost) + 5 * count(DISTINCT choice) AS BIGINT) AS union_bytes, max(budget) AS budget, sum(cost) + 5 * count(DISTINCT choice) <= max(budget) AS fits FROM c JOIN {_CHOICES} USING (region, nation, choice) JOIN {_BUDGETS} USING (region) GROUP BY region""")
def plan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region's selection needs in all, with five more for every segment that it takes anywhere, once."""
    c = _budgeted(spark, sf_dir)
    own = F.struct(F.concat_ws("-", "nation", "choice").alias("id"), F.col("cost").cast("long").alias("bytes"))
    shared = F.struct(F.concat(F.lit("segment"), F.col("choice")).alias("id"), F.lit(5).cast("long").alias("bytes"))
    targets = c.withColumn("resources", F.array(own, shared))
    best = select_within_budget(c, "region", "nation", "choice", "cost", "utility", "budget").select("region", F.posexplode("selection").alias("i", "choice"))
    place = c.select("region", "nation").distinct().withColumn("i", F.row_number().over(Window.partitionBy("region").orderBy("nation")) - 1)
    planned = best.join(place, ["region", "i"]).select("region", "nation", "choice")
    return planning.plan_rates(planned, targets, "region", "nation", "choice", "resources", "budget")


@query("""SELECT coalesce(CAST(l_returnflag AS VARCHAR), 'all') AS kind, coalesce(CAST(l_linestatus AS VARCHAR), 'all') AS step, coalesce(CAST(l_linenumber AS VARCHAR), 'all') AS items, count(*) AS cases, count(*) FILTER (WHERE g <= 0.5) AS feasible, round(max(g), 6) AS largest_gap, round(median(g), 6) AS median_gap
FROM (SELECT *, abs(l_extendedprice - l_quantity * 1500) / l_extendedprice AS g FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber))""")
def discretisation_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative gaps of an estimate at two grains: by kind and step, and by number of items."""
    g = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500) / F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem")
    kinds = lines.select("l_returnflag", "l_linestatus", "l_linenumber").dtypes
    grain = lambda k, *keep: F.struct(F.lit(k).alias("grain"), *[(F.col(c) if c in keep else F.lit(None).cast(t)).alias(c) for c, t in kinds])
    grains = F.explode(F.array(grain(0, "l_returnflag", "l_linestatus"), grain(1, "l_linenumber")))
    rows = lines.select(grains.alias("b"), g.alias("g")).select("b.*", "g")
    facts = [F.count("*").alias("cases"), F.count_if(F.col("g") <= 0.5).alias("feasible"), F.round(F.max("g"), 6).alias("largest_gap")]
    out = metrics.medians(rows, ["grain", "l_returnflag", "l_linestatus", "l_linenumber"], "g", facts).withColumn("median_gap", F.round("median", 6))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all"))
    return out.select(name("l_returnflag").alias("kind"), name("l_linestatus").alias("step"), name("l_linenumber").alias("items"), "cases", "feasible", "largest_gap", "median_gap")


@query("""WITH a AS (SELECT l_suppkey % 10 AS g, l_linenumber AS i, year(l_shipdate) AS t, sum(l_quantity * l_discount) AS s, sum(l_quantity * least(l_tax, l_discount)) AS v FROM lineitem GROUP BY ALL)
SELECT g, i, round(sum(s), 3) AS solo, round(sum(v), 3) AS visible, round(CASE WHEN sum(s) > 0 THEN 1 - sum(v) / sum(s) END, 6) AS occlusion, string_agg(t || ':' || printf('%.3f', round(CASE WHEN s > 0 THEN 1 - v / s END, 3)), ',' ORDER BY t) AS series FROM a GROUP BY g, i""")
def visibility_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of lines' discounts their taxes show, in all and by year."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_linenumber").alias("i"), F.year("l_shipdate").alias("t"), "l_quantity", "l_discount", F.least("l_tax", "l_discount").alias("v"))
    out = reports.visibility_in_time(rows, ["g"], "t", "i", "l_quantity", "l_discount", "v")
    text = F.array_join(F.transform("series", lambda x: F.concat_ws(":", x["time"].cast("string"), F.format_string("%.3f", F.round(x["occlusion"], 3)))), ",")
    return out.select("g", "i", F.round("solo", 3).alias("solo"), F.round("visible", 3).alias("visible"), F.round("occlusion", 6).alias("occlusion"), text.alias("series"))


@query("SELECT o_orderkey AS \"order_key\", o_custkey AS order_customer_key, c_nationkey AS order_customer_nation, o_totalprice AS price, '[' || o_orderkey || ',' || o_custkey || ']' AS keys FROM orders JOIN customer ON c_custkey = o_custkey")
def flattened_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that hold their customer as a struct within a struct, as one flat table."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    customer = F.struct(F.col("o_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    nested = joined.select(F.struct(F.col("o_orderkey").alias("key"), customer.alias("customer")).alias("order"), F.col("o_totalprice").alias("price"), F.array("o_orderkey", "o_custkey").alias("keys"))
    return reports.flattened(nested)


@query("SELECT l_returnflag, p_brand, l_linenumber, month FROM (SELECT DISTINCT l_returnflag, p_brand, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey), (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders) EXCEPT SELECT l_returnflag, p_brand, l_linenumber, strftime(l_shipdate, '%Y-%m') FROM lineitem JOIN part ON p_partkey = l_partkey")
def uncovered_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders in which a brand has no line of some state and place shipped."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_returnflag", "p_brand", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    wanted = rows.select("l_returnflag").distinct().join(months.distinct())  # a handful of states by months
    return reports.uncovered(rows, ["l_returnflag", "p_brand", "l_linenumber"], "month", wanted, ["l_returnflag"])
