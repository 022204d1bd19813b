"""Queries over time series: joins in time, weights, integrals, intervals, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import temporal as t
from tidelake.registry import query
from tidelake.sources.tables import table

_EVENTS = "(SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", t.seconds(F.col("ts")))


def order_intervals(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """o_custkey, o_orderkey, s, e: an order's days from its date to its last shipment, or `days` on."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("s"))
    if days is not None:
        return orders.withColumn("e", F.col("s") + days)
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.datediff("l_shipdate", F.lit("1970-01-01"))).cast("long").alias("e"))
    return orders.join(last, "o_orderkey")


_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT)"
_INTERVALS = f"(SELECT o_custkey, o_orderkey, {_DAY.format('o_orderdate')} AS s, max({_DAY.format('l_shipdate')}) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"""SELECT p.event_id, p.user_id, coalesce(c.event_id, -1) AS click_id, round(c.value, 6) AS click_value
FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT DISTINCT ON (user_id, t) * FROM {_EVENTS} WHERE event_type = 'click' ORDER BY user_id, t, event_id) c ON p.user_id = c.user_id AND p.t >= c.t""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the user's latest click at or before them."""
    e = events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").groupBy("user_id", "t").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("c")).select("user_id", "t", F.col("c.event_id").alias("event_id"), F.col("c.value").alias("value"))
    out = t.asof_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "t", "t", ["event_id", "value"], "click_")
    return out.select("event_id", "user_id", F.coalesce("click_event_id", F.lit(-1)).alias("click_id"), F.round("click_value", 6).alias("click_value"))


@query(f"""SELECT p.event_id, min(c.t - p.t) AS wait_s FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'click') p
LEFT JOIN (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') c ON p.user_id = c.user_id AND c.t > p.t GROUP BY p.event_id""".replace("min(c.t - p.t)", "round(min(c.t - p.t), 6)"))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the wait until the user's next purchase strictly after them."""
    e = events(spark, sf_dir)
    buys = e.where("event_type = 'purchase'").select("user_id", "t").distinct()
    out = t.asof_join(e.where("event_type = 'click'"), buys, ["user_id"], "t", "t", ["t"], "next_", forward=True, strict=True)
    return out.select("event_id", F.round(F.col("next_t") - F.col("t"), 6).alias("wait_s"))


@query(f"""SELECT b AS band, count(*) AS n, round(sum(p_retailprice), 4) AS price FROM part JOIN (SELECT b, b * 7 AS lo, b * 7 + 7 AS hi FROM range(0, 10) r(b)) ON p_size >= lo AND p_size < hi GROUP BY b""")
def range_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in half-open bands of size."""
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 7).alias("lo"), (F.col("id") * 7 + 7).alias("hi"))
    met = t.range_join(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), bands, "p_size", "lo", "hi", width=7)
    return met.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("price"))


@query(f"""SELECT a.event_id, count(b.event_id) AS n_between FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {_EVENTS} WHERE event_type = 'purchase') a
LEFT JOIN {_EVENTS} b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.t > a.p AND b.t <= a.t GROUP BY a.event_id""")
def events_in_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user in the gap (previous purchase, purchase], by purchase; one sort serves all."""
    e = events(spark, sf_dir).where("event_type IN ('purchase', 'view')").withColumn("view", (F.col("event_type") == "view").cast("long"))
    upto = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("seen", F.sum("view").over(upto)).where("event_type = 'purchase'")
    before = F.lag("seen").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return seen.select("event_id", F.coalesce(F.col("seen") - before, F.lit(0)).alias("n_between"))


@query(f"""SELECT user_id, round(sum(value * h) / nullif(sum(h), 0), 6) AS held_mean FROM (SELECT user_id, value, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t) - t AS h FROM {_EVENTS}) GROUP BY user_id""")
def held_mean_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-weighted mean of each user's left-held values."""
    return t.held_mean(events(spark, sf_dir), ["user_id"], "t", "value").withColumn("held_mean", F.round("held_mean", 6))


@query(f"""SELECT user_id, round(sum(v * dt) / nullif(sum(dt), 0), 6) AS trapezoid_mean FROM (SELECT user_id, (value + lead(value) OVER w) / 2 AS v, lead(t) OVER w - t AS dt FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t)) GROUP BY user_id""")
def trapezoid_mean_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each user's values by the trapezoid rule."""
    return t.trapezoid_mean(events(spark, sf_dir), ["user_id"], "t", "value").withColumn("trapezoid_mean", F.round("trapezoid_mean", 6))


@query(f"""WITH held AS (SELECT user_id, value, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM {_EVENTS}),
days AS (SELECT DISTINCT user_id, floor(t / 86400) * 86400 AS day FROM {_EVENTS})
SELECT user_id, day, round(sum(value * greatest(least(e, day + 86400) - greatest(s, day), 0)), 3) AS integral FROM days JOIN held USING (user_id) WHERE e > s AND s < day + 86400 AND e > day GROUP BY ALL""")
def daily_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral of each user's left-held values over the days on which the user has events."""
    e = events(spark, sf_dir)
    days = e.select("user_id", (F.floor(F.col("t") / 86400) * 86400.0).alias("day")).distinct().withColumn("day_end", F.col("day") + 86400)
    out = t.step_integral(e, ["user_id"], "t", "value", days, "day", "day_end", 86400.0)
    return out.select("user_id", "day", F.round("integral", 3).alias("integral")).where("integral is not null")


@query(f"""SELECT o_custkey, CAST(sum(greatest(e - greatest(s, coalesce(r, s)), 0)) AS BIGINT) AS busy_days FROM (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {_INTERVALS} WHERE e > s) GROUP BY o_custkey""")
def busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a customer has an order under way."""
    return t.interval_union(order_intervals(spark, sf_dir), ["o_custkey"], "s", "e", "busy_days")


@query(f"""SELECT o_custkey, CAST(max(o) AS BIGINT) AS peak FROM (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY x, d ROWS UNBOUNDED PRECEDING) AS o FROM
(SELECT o_custkey, {_DAY.format('o_orderdate')} AS x, 1 AS d FROM orders UNION ALL SELECT o_custkey, {_DAY.format('o_orderdate')} + 60, -1 FROM orders)) GROUP BY o_custkey""")
def peak_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most orders of a customer within 60 days of each other's start."""
    return t.peak_concurrency(order_intervals(spark, sf_dir, 60), ["o_custkey"], "s", "e").withColumn("peak", F.col("peak").cast("long"))


@query(f"""SELECT user_id, island, min(t) AS started, max(t) - min(t) AS length_s, count(*) AS n FROM (SELECT user_id, t, CAST(sum(CASE WHEN p IS NULL OR t > p + 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM {_EVENTS})) GROUP BY ALL""".replace("max(t) - min(t) AS", "round(max(t) - min(t), 6) AS"))
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events at most six hours apart."""
    out = t.islands(events(spark, sf_dir).withColumn("e", F.col("t")), ["user_id"], "t", "e", 21600.0)
    return out.select("user_id", F.col("island").cast("long").alias("island"), F.col("start").alias("started"), F.round(F.col("end") - F.col("start"), 6).alias("length_s"), "n")


@query(f"""SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS moving_mean FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_mean_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-event moving mean, null until there are five."""
    out = t.moving_mean(events(spark, sf_dir), ["user_id"], "t", "value", 5, "event_id")
    return out.select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


@query(f"""SELECT user_id, CAST(sum(CASE WHEN p IS NOT NULL AND p <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {_EVENTS}) GROUP BY user_id""")
def type_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's event type differs from the one before."""
    return t.changes(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").groupBy("user_id").agg(F.sum(F.col("changed").cast("long")).alias("switches"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS "offset" FROM lineitem""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offset of each line in its order, in quantity."""
    out = t.running_offset(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("offset", 4).alias("offset"))


@query(f"""SELECT user_id, round(s, 6) AS started, round(t, 6) AS ended FROM (SELECT user_id, event_type, t, lag(event_type) OVER w AS k, lag(t) OVER w AS s FROM {_EVENTS} WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE event_type = 'purchase' AND k = 'click'""")
def click_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases paired with the click right before them."""
    out = t.pair_starts_with_ends(events(spark, sf_dir), ["user_id"], "t", "event_type", "click", "purchase", "event_id")
    return out.select("user_id", F.round("started", 6).alias("started"), F.round("ended", 6).alias("ended"))


@query(f"""SELECT l_orderkey, l_linenumber, round(max(a - (s - q)) OVER w + s, 4) AS finish FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST({_DAY.format('l_shipdate')} AS DOUBLE) AS a, l_quantity / 50 AS q, sum(l_quantity / 50) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS s FROM lineitem)
WINDOW w AS (PARTITION BY l_suppkey ORDER BY a, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)""")
def supplier_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a single server: when each line is done, in days, at 50 units a day."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("double").alias("a"), (F.col("l_quantity") / 50).alias("q"))
    out = t.finish_times(lines, ["l_suppkey"], "a", "q", ["a", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("finish", 4).alias("finish"))


@query(f"""SELECT event_id, round(t - p, 6) AS gap_s, coalesce(t - p > 86400, false) AS late FROM (SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {_EVENTS})""")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap to the user's event before, and whether it is over a day."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return events(spark, sf_dir).withColumn("g", gap).select("event_id", F.round("g", 6).alias("gap_s"), F.coalesce(F.col("g") > 86400, F.lit(False)).alias("late"))


@query(f"""SELECT user_id, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS prefix FROM (SELECT user_id, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) = 1 AS ok FROM {_EVENTS}) GROUP BY user_id""")
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events a user has before the first error."""
    upto = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.min((F.col("event_type") != "error").cast("int")).over(upto)
    return events(spark, sf_dir).withColumn("ok", fine).groupBy("user_id").agg(F.sum("ok").cast("long").alias("prefix"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("w"), "event_type", "n", "total")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS w, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(0, 6) r(k) GROUP BY ALL""")
def hopping_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows every hour."""
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("w"), "n", "mean")
