"""Queries of event-time operators in batch form; tests run the same functions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.registry import query
from tidelake.sources.tables import table
from tidelake.streaming import batches, states


@query("SELECT user_id, CAST(count(DISTINCT event_id) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def duplicates_counted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice, out of order, count once."""
    e = table(spark, sf_dir, "events")
    twice = e.unionByName(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])
    return twice.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, count(*) AS n_sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after thirty minutes without an event."""
    rows = states.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", "user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


_SEGMENTS = "(SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, 3600.0::DOUBLE AS m FROM events)"


@query(f"""WITH a AS (SELECT *, sum(m) OVER w AS have, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NULL AS final FROM {_SEGMENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(bool_or(have >= 14400 OR final) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM a),
c AS (SELECT *, CASE WHEN begun THEN t - (have - m) WHEN have >= 14400 OR final THEN t END AS lag_s FROM b),
d AS (SELECT *, max(lag_s) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c)
SELECT user_id, round(min(t) FILTER (WHERE lag_s IS NOT NULL AND NOT begun), 3) AS started, round(coalesce(sum(lag_s - held) FILTER (WHERE begun AND lag_s > held + 1e-9), 0), 3) AS stalled_s, count(*) FILTER (WHERE begun AND lag_s > held + 1e-9) AS n_stalls, sum(m) AS played_s FROM d GROUP BY user_id""")
def playback_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as segments of an hour of media each, played from a buffer of four hours."""
    segments = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.lit(3600.0).alias("media_s"))
    return states.playback(segments, 4 * 3600.0).withColumns({"started": F.round("started", 3), "stalled_s": F.round("stalled_s", 3)})


@query("SELECT event_id, coalesce(arg_max(v, ts) OVER w, '') AS held FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)".replace("coalesce(arg_max(v, ts) OVER w, '')", "coalesce(last_value(v IGNORE NULLS) OVER w, '')"))
def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event type that is no error, carried forward."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") != "error", F.col("event_type")), ignorenulls=True).over(upto)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(seen, F.lit("")).alias("held"))


@query("SELECT user_id, b AS bucket, arg_min(event_id, ts) AS event_id FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS b FROM events) GROUP BY ALL".replace("arg_min(event_id, ts)", "arg_min(event_id, struct_pack(t := ts, e := event_id))"))
def cadenced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user's day."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 day")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return rows.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_id")


_TRANSFERS = """SELECT o_custkey AS k, o_orderkey AS s, d + 90 AS received, CAST(l_partkey AS VARCHAR) AS id, l_quantity AS wanted, CASE WHEN l_discount >= 0.1 AND l_tax >= 0.06 THEN l_quantity - 1 ELSE l_quantity END AS got, greatest(d, e - 3 * l_linenumber) AS a, e AS z
FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as transfers of a batch that is received ninety days after the order; some come in part."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    got = F.when((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.06), F.col("l_quantity") - 1).otherwise(F.col("l_quantity"))
    return joined.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("s"), (day("o_orderdate") + 90).alias("received"), F.col("l_partkey").cast("string").alias("id"), F.col("l_quantity").alias("wanted"), got.alias("got"), F.greatest(day("o_orderdate"), day("l_shipdate") - 3 * F.col("l_linenumber")).alias("a"), day("l_shipdate").alias("z"))


@query(f"""
WITH RECURSIVE t AS ({_TRANSFERS}),
busy AS (SELECT k, s, sum(greatest(z - greatest(a, coalesce(reach, a)), 0)) AS busy FROM (SELECT *, max(z) OVER (PARTITION BY k, s ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WHERE z > a) GROUP BY k, s),
b AS (SELECT k, s, max(received) AS received, list(DISTINCT id) AS ids, sum(got) AS got, CASE WHEN bool_or(got <> wanted) THEN 'partial' WHEN bool_or(z > received) THEN 'future' WHEN bool_or(a > z OR wanted > 0 AND z = a) THEN 'interval' WHEN count(DISTINCT id) < count(*) THEN 'repeated' END AS fault, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM t GROUP BY k, s),
c AS (SELECT b.*, CASE WHEN fault IS NULL THEN b.got / busy END AS rate FROM b LEFT JOIN busy USING (k, s)),
run AS (
  SELECT k, CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS clock, CAST([] AS VARCHAR[]) AS seen, CAST([] AS DOUBLE[]) AS rates, CAST(NULL AS VARCHAR) AS fault, CAST(0 AS BIGINT) AS good FROM (SELECT DISTINCT k FROM c)
  UNION ALL
  SELECT k, s, n, CASE WHEN f IS NULL THEN received ELSE clock END, CASE WHEN f IS NULL THEN list_concat(seen, ids) ELSE seen END, CASE WHEN f IS NULL AND rate > 0 THEN list_append(rates, rate)[-5:] ELSE rates END, f, good + CASE WHEN f IS NULL THEN 1 ELSE 0 END
  FROM (SELECT c.k, c.s, c.n, r.clock, r.seen, r.rates, r.good, c.received, c.ids, c.rate, coalesce(c.fault, CASE WHEN list_has_any(r.seen, c.ids) THEN 'repeated' WHEN c.received < r.clock THEN 'late' END) AS f FROM run r JOIN c ON c.k = r.k AND c.n = r.n + 1))
SELECT k AS "key", s AS seq, fault, good AS n_accepted, round(len(rates) / list_sum(list_transform(rates, lambda x: 1 / x)), 6) AS estimate FROM run WHERE n > 0""")
def observed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as batches of transfers, which count whole or not at all, and the estimate after each."""
    rows = batches.batches(order_transfers(spark, sf_dir), "k", "s", "received", "id", "wanted", "got", "a", "z")
    return batches.fold(rows).withColumn("estimate", F.round("estimate", 6))
