"""Queries of clocks and looping timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import clock, timeline
from tidelake.registry import query
from tidelake.sources.tables import table

_MINUTE = 60_000_000
#: A frame every ten minutes, a loop of a day.
_STEP, _TICKS = 10 * _MINUTE, 144
_COMMAND = "CASE event_type WHEN 'click' THEN 'play' WHEN 'view' THEN 'frame' WHEN 'error' THEN 'stall' WHEN 'purchase' THEN 'seek' ELSE CASE WHEN event_id % 3 = 0 THEN 'pause' ELSE 'unstall' END END"


@query(f"""
WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS t, {_COMMAND} AS c, CAST(floor(value) AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS t, true AS playing, CAST(NULL AS BIGINT) AS since, CAST(0 AS BIGINT) AS tick, CAST(NULL AS BIGINT) AS due, CAST(0 AS BIGINT) AS stalled, 0 AS n FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL
  SELECT c.user_id, c.event_id, c.k, c.t,
    CASE c.c WHEN 'play' THEN true WHEN 'pause' THEN false ELSE playing END,
    CASE WHEN c.c IN ('pause', 'seek', 'unstall', 'frame') THEN NULL WHEN c.c = 'stall' AND playing THEN coalesce(since, c.t) ELSE since END,
    CASE c.c WHEN 'seek' THEN greatest(0, least(c.x, {_TICKS - 1})) WHEN 'frame' THEN (tick + 1) % {_TICKS} ELSE tick END,
    CASE WHEN c.c IN ('play', 'seek') THEN c.t WHEN c.c IN ('pause', 'unstall') AND since IS NOT NULL THEN c.t WHEN c.c = 'frame' AND since IS NOT NULL THEN c.t + {_STEP} WHEN c.c = 'frame' THEN greatest(coalesce(due + {_STEP}, c.t), c.t) ELSE due END,
    stalled + CASE WHEN c.c IN ('pause', 'seek', 'unstall', 'frame') AND since IS NOT NULL THEN c.t - since ELSE 0 END,
    n + CASE WHEN c.c = 'stall' AND playing AND since IS NULL THEN 1 ELSE 0 END
  FROM run r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
SELECT event_id, CASE WHEN since IS NOT NULL THEN 2 WHEN playing THEN 1 ELSE 0 END AS mode, tick AS tick_now, due AS deadline, stalled + CASE WHEN since IS NULL THEN 0 ELSE t - since END AS stalled_total, n AS n_stalls FROM run WHERE k > 0""")
def scene_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as commands of a clock: place, deadline, mode and stalls after every one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.expr(_COMMAND).alias("command"), F.floor("value").alias("x"))
    return clock.run_clock(e, ["user_id"], ["t", "event_id"], "command", "t", "x", _STEP, _TICKS).select("event_id", "mode", "tick_now", "deadline", "stalled_total", "n_stalls")


_LOOPS = "SELECT user_id, (17 + user_id % 7) * 60 AS s, 95 + user_id % 11 AS p, CAST(ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0) AS BIGINT) + 1 AS total, min(ts) AS first FROM events GROUP BY user_id"


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user: minutes of a source, of a piece and of all, and when it begins."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.ceil((us(F.max("ts")) - us(F.min("ts"))) / 60000000.0) + 1).alias("total"), F.min("ts").alias("first"))
    return e.select("user_id", ((17 + F.col("user_id") % 7) * 60).alias("s"), (95 + F.col("user_id") % 11).alias("p"), "total", "first")


@query(f"""
WITH u AS ({_LOOPS}), cuts AS (
  SELECT user_id, s, p, total, unnest(range(0, total, s)) AS c FROM u UNION
  SELECT user_id, s, p, total, l + g FROM (SELECT *, unnest(range(0, total, s)) AS l FROM u), unnest(range(0, s, p)) t(g) WHERE l + g < total),
seg AS (SELECT user_id, s, p, row_number() OVER (PARTITION BY user_id ORDER BY c) - 1 AS segment, c AS start, coalesce(lead(c) OVER (PARTITION BY user_id ORDER BY c), total) AS stop FROM cuts),
ev AS (SELECT user_id, (epoch_us(ts) - epoch_us(first)) // 60000000 AS m FROM events JOIN u USING (user_id))
SELECT user_id, segment, start // s AS loop, start % s // p AS gop, start, stop AS "end", start % s AS content_start, start % s + stop - start AS content_end, (SELECT count(*) FROM ev WHERE ev.user_id = seg.user_id AND m >= start AND m < stop) AS n_events FROM seg""")
def looping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's time cut at pieces, loops and its end, with how many events fall into each cut."""
    u = loops(spark, sf_dir)
    segments = timeline.looping_segments(u, ["user_id"], "s", "p", "total")
    minute = F.expr("(unix_micros(cast(ts AS timestamp)) - unix_micros(cast(first AS timestamp))) DIV 60000000")
    events = timeline.located(table(spark, sf_dir, "events").join(u, "user_id").withColumn("m", minute), "m", "s", "p")
    n = events.groupBy("user_id", "segment").agg(F.count("*").alias("n_events"))
    return segments.join(n, ["user_id", "segment"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


#: An order's lines as entries of a timeline: some begin anew, some go on to the next start, a few have no length.
_ENTRIES = """SELECT l_orderkey, k, CASE WHEN dis = 5 THEN 200 * k + tax END AS t, CASE WHEN dis = 9 THEN 0 ELSE q END AS d, CASE WHEN dis = 4 THEN -1 ELSE tax % 3 END AS r, 2000 AS stop
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS dis FROM {lineitem}) x"""


@query(f"""WITH e AS ({_ENTRIES.format(lineitem="lineitem")}),
a AS (SELECT *, coalesce(lead(t) OVER w, CASE WHEN lead(k) OVER w IS NULL THEN stop END) AS till, sum(CASE WHEN t IS NULL THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
b AS (SELECT *, CASE WHEN d <= 0 THEN 'length' WHEN r = -1 AND till IS NULL THEN 'repeat' END AS bad FROM a),
c AS (SELECT *, coalesce(first_value(t) OVER w, 0) + coalesce(sum(CASE WHEN bad IS NULL AND r >= 0 THEN d * (r + 1) ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b WINDOW w AS (PARTITION BY l_orderkey, run ORDER BY k)),
n AS (SELECT *, CAST(CASE WHEN bad IS NOT NULL THEN 1 WHEN r = -1 THEN greatest(ceil((till - s) / d), 0) ELSE r + 1 END AS BIGINT) AS n, CASE WHEN bad IS NOT NULL THEN s WHEN r = -1 THEN greatest(till, s) ELSE s + d * (r + 1) END AS fin FROM c),
f AS (SELECT *, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, CASE WHEN bad IS NOT NULL THEN bad WHEN t < lag(fin) OVER w THEN 'overlap' WHEN t > lag(fin) OVER w THEN 'gap' END AS fault FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY k))
SELECT l_orderkey, CAST(base + i AS BIGINT) AS number, CAST(CASE WHEN bad IS NULL THEN s + i * d ELSE s END AS BIGINT) AS start, CAST(CASE WHEN bad IS NOT NULL THEN NULL WHEN r = -1 THEN least(d, till - s - i * d) ELSE d END AS BIGINT) AS length, CASE WHEN i = 0 THEN fault END AS fault FROM f, LATERAL (SELECT unnest(range(0, n)) AS i)""")
def expanded_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each order's run-length timeline, with what is wrong with its entries."""
    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *place, F.col("l_quantity").cast("long").alias("q"), hundredths("l_tax").alias("tax"), hundredths("l_discount").alias("dis"))
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*place))
    e = rows.select("l_orderkey", *place, F.when(F.col("dis") == 5, 200 * k + F.col("tax")).alias("t"), F.when(F.col("dis") == 9, 0).otherwise(F.col("q")).alias("d"), F.when(F.col("dis") == 4, -1).otherwise(F.col("tax") % 3).alias("r"), F.lit(2000).alias("stop"))
    return timeline.expanded(e, ["l_orderkey"], place, "t", "d", "r", "stop")
