"""Queries of dependency graphs: orders, sums and faults."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import graphs, packages
from tidelake.operators.storage import Scratch
from tidelake.registry import query
from tidelake.sources.tables import table

#: Parts of over half the sizes need smaller ones; those of the largest need their neighbour, which may need them.
_NEEDS = "SELECT p_partkey AS c, p_partkey - p_size AS p FROM part WHERE p_size BETWEEN 26 AND 45 UNION SELECT p_partkey, p_partkey - p_size // 2 FROM part WHERE p_size BETWEEN 26 AND 45 AND p_size % 2 = 0 UNION SELECT p_partkey, xor(p_partkey, 1) FROM part WHERE p_size > 45"


@query(f"""
WITH RECURSIVE e AS ({_NEEDS}),
clo AS (SELECT c, p FROM e UNION SELECT clo.c, e.p FROM clo JOIN e ON e.c = clo.p),
turning AS (SELECT DISTINCT c FROM clo WHERE c = p),
lacks AS (SELECT DISTINCT c FROM e WHERE p NOT IN (SELECT p_partkey FROM part)),
behind AS (SELECT c FROM turning UNION SELECT c FROM lacks UNION SELECT c FROM clo WHERE p IN (SELECT c FROM turning) OR p IN (SELECT c FROM lacks)),
looped AS (SELECT c FROM turning UNION SELECT a.c FROM clo a JOIN clo b ON b.p = a.c WHERE a.p IN (SELECT c FROM turning) AND b.c IN (SELECT c FROM turning)),
depth AS (SELECT p_partkey AS n, CAST(0 AS BIGINT) AS d FROM part WHERE p_partkey NOT IN (SELECT c FROM e) UNION SELECT e.c, d + 1 FROM depth JOIN e ON e.p = n WHERE e.c NOT IN (SELECT c FROM behind))
SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT c FROM behind) THEN max(d) END AS layer,
  CASE WHEN p_partkey IN (SELECT c FROM lacks) THEN 'missing parent' WHEN p_partkey IN (SELECT c FROM looped) THEN 'cycle' WHEN p_partkey IN (SELECT c FROM behind) THEN 'blocked' END AS fault
FROM part LEFT JOIN depth ON n = p_partkey GROUP BY p_partkey""")
def decode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer in which each part can be made, after all that it needs, or what forbids it."""
    part = table(spark, sf_dir, "part")
    row = lambda df, p: df.select(F.col("p_partkey").alias("c"), F.expr(p).alias("p"))
    some = part.where("p_size BETWEEN 26 AND 45")
    needs = row(some, "p_partkey - p_size").unionByName(row(some.where("p_size % 2 = 0"), "p_partkey - p_size DIV 2")).unionByName(row(part.where("p_size > 45"), "p_partkey ^ 1"))
    return graphs.decode_layers(part, needs, "p_partkey", "c", "p")


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT c_custkey AS n, c_custkey - (c_nationkey + 1) AS p, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer),
run AS (SELECT n, v AS s, CAST(0 AS BIGINT) AS d FROM t WHERE p < (SELECT min(n) FROM t) UNION ALL SELECT t.n, s + t.v, d + 1 FROM run JOIN t ON t.p = run.n)
SELECT n AS c_custkey, d AS layer, s AS total FROM run""")
def chain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's chain of referrers, hundreds long, holds in all: each was sent by one a little before it."""
    c = table(spark, sf_dir, "customer")
    up = F.col("c_custkey") - (F.col("c_nationkey") + 1)
    first = c.agg(F.min("c_custkey").alias("first"))
    nodes = c.join(F.broadcast(first)).select("c_custkey", F.when(up >= F.col("first"), up).alias("up"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))  # first: one row
    return graphs.chain_sums(nodes, "c_custkey", "up", "cents").select("c_custkey", "layer", "total")


#: A package a customer: orders are its frames, lines its payloads, a segment for each line number, status and epoch of four frames. Some lines break a rule.
#: These texts run in both engines; package_tables() has Spark round where DuckDB does.
_FRAMES = "SELECT o_custkey AS package, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey AS frame, CAST(o_totalprice AS BIGINT) AS moment FROM {orders}"
_LINES = """SELECT o_custkey AS package, l_orderkey * 100 + line AS id, l_linestatus AS mode, line AS quality, l_orderkey AS frame, CAST(floor((place - 1) / 4) AS BIGINT) AS e, moment, CAST(l_quantity AS BIGINT) AS bytes, l_partkey AS digest, l_returnflag, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS dis
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line FROM {lineitem}) l0 JOIN {orders} ON o_orderkey = l_orderkey JOIN (""" + _FRAMES + """) f ON f.package = o_custkey AND f.frame = o_orderkey"""
#: The same lines for Spark, which has their order's packages from _FRAMES alone: an order that repeats in a package is joined with each of its frames as often, and lines are dealt by order once.
_NUMBERED = """SELECT package, frame, place, moment, quality, mode, bytes, digest, l_returnflag, tax, dis
FROM (SELECT l_orderkey, l_linestatus AS mode, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS quality, bytes, l_partkey AS digest, l_returnflag, tax, dis
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS bytes, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS dis FROM {lineitem}) l0) l
JOIN (SELECT package, frame, place, moment, explode(array_repeat(0, CAST(n AS INT))) FROM (SELECT *, count(*) OVER (PARTITION BY package, frame) AS n FROM {frames} WHERE package IS NOT NULL AND frame IS NOT NULL) f0) f ON frame = l_orderkey"""
_PAYLOADS = "SELECT package, id, mode, quality, CASE WHEN tax = 8 AND dis = 1 THEN -1 ELSE frame END AS frame, e + CASE WHEN tax = 8 AND dis = 2 THEN 1 ELSE 0 END AS epoch, moment + CASE WHEN tax = 8 AND dis = 3 THEN 1 ELSE 0 END AS moment, bytes, digest, l_returnflag = 'A' AS refresh FROM {lines} l"
_NEEDED = "SELECT package, id, CASE WHEN tax = 7 AND dis = 1 THEN id - 101 ELSE id - 1 END AS parent FROM {lines} l WHERE quality > 1 UNION ALL SELECT package, id, id + 1 FROM {lines} l WHERE quality = 1 AND tax = 7 AND dis = 2"
_SEGMENT = "concat_ws('-', mode, quality, e)"
_MEMBERS = "SELECT package, " + _SEGMENT + """ AS segment, row_number() OVER (PARTITION BY package, mode, quality, e ORDER BY id) AS place, CASE WHEN tax = 6 AND dis = 1 THEN -id ELSE id END AS id,
CAST(16 + coalesce(sum(bytes) OVER (PARTITION BY package, mode, quality, e ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN tax = 6 AND dis = 2 THEN 1 WHEN tax = 6 AND dis = 3 THEN -1 ELSE 0 END AS BIGINT) AS offset, bytes + CASE WHEN tax = 6 AND dis = 4 THEN 1 ELSE 0 END AS length, digest FROM {lines} l"""
_SEGMENTS = "SELECT package, " + _SEGMENT + " AS segment, mode, quality, e AS epoch, 16 AS header, CAST(16 + sum(bytes) + CASE WHEN max(tax) = 5 THEN 1 ELSE 0 END AS BIGINT) AS bytes, min(frame) AS first_frame, max(frame) + CASE WHEN max(dis) = 5 THEN 1 ELSE 0 END AS last_frame FROM {lines} l GROUP BY package, mode, quality, e"


def _package_sql() -> str:
    t = {"orders": "orders", "lineitem": "lineitem"}
    t["lines"] = "(" + _LINES.format(**t) + ")"
    row = lambda rule, key, rest: f"SELECT DISTINCT package, '{rule}' AS rule, {key} AS key FROM {rest}"
    text = lambda *c: " || ':' || ".join(f"CAST({x} AS VARCHAR)" for x in c)
    rules = [
        row("frame repeats", text("frame"), "(SELECT package, frame FROM frames GROUP BY ALL HAVING count(*) > 1)"),
        row("frame order", text("frame"), "ordered WHERE frame <= f OR moment <= t"),
        row("payload repeats", text("id"), "(SELECT package, id FROM payloads GROUP BY ALL HAVING count(*) > 1)"),
        row("unknown frame", text("id"), "placed WHERE position IS NULL"),
        row("wrong epoch", text("id"), "placed WHERE epoch <> position // 4"),
        row("timestamp differs", text("id"), "placed WHERE moment <> media"),
        row("sample missing", text("mode", "quality", "frame"), "(SELECT DISTINCT package, mode, quality FROM payloads) k JOIN known USING (package) ANTI JOIN payloads USING (package, mode, quality, frame)"),
        row("no refresh", text("id"), "placed p WHERE position IS NOT NULL AND NOT EXISTS (SELECT 1 FROM placed q WHERE q.package = p.package AND q.mode = p.mode AND q.quality = p.quality AND q.position // 4 = p.position // 4 AND q.position <= p.position AND q.refresh)"),
        row("dependency of another frame", text("n.id", "n.parent"), "needs n JOIN payloads a USING (package, id) JOIN payloads b ON b.package = n.package AND b.id = n.parent WHERE a.frame <> b.frame").replace("DISTINCT package", "DISTINCT n.package"),
        row("missing dependency", text("id"), "needs n SEMI JOIN payloads p USING (package, id) WHERE (package, parent) NOT IN (SELECT (package, id) FROM payloads)"),
        row("dependency cycle", text("c"), "turning WHERE c NOT IN (SELECT id FROM needs n WHERE (package, parent) NOT IN (SELECT (package, id) FROM payloads))"),
        row("unpackaged payload", text("id"), "payloads ANTI JOIN members USING (package, id)"),
        row("unknown member", text("segment", "id"), "members ANTI JOIN payloads USING (package, id)"),
        row("member differs", text("segment", "m.id"), "members m JOIN payloads p USING (package, id) WHERE m.length <> p.bytes OR m.digest <> p.digest"),
        row("offset gap", text("segment", "id"), "swept w WHERE w.offset > due"),
        row("offset overlap", text("segment", "id"), "swept w WHERE w.offset < due"),
        row("segment length", text("segment"), "(SELECT package, segment, s.bytes, max(m.offset + length) AS stop FROM swept m JOIN segments s USING (package, segment) GROUP BY ALL) WHERE stop <> bytes"),
        row("segment crosses", text("segment", "m.id"), "members m JOIN payloads p USING (package, id) JOIN segments s USING (package, segment) WHERE p.mode <> s.mode OR p.quality <> s.quality OR p.epoch <> s.epoch"),
        row("frame range", text("segment"), "segments s LEFT JOIN (SELECT package, segment, min(frame) AS lo, max(frame) AS hi FROM members JOIN payloads USING (package, id) GROUP BY ALL) USING (package, segment) WHERE first_frame IS DISTINCT FROM lo OR last_frame IS DISTINCT FROM hi"),
    ]
    return f"""WITH RECURSIVE frames AS ({_FRAMES.format(**t)}), payloads AS MATERIALIZED ({_PAYLOADS.format(**t)}), needs AS MATERIALIZED ({_NEEDED.format(**t)}), members AS MATERIALIZED ({_MEMBERS.format(**t)}), segments AS MATERIALIZED ({_SEGMENTS.format(**t)}),
ordered AS (SELECT *, lag(frame) OVER w AS f, lag(moment) OVER w AS t, row_number() OVER w - 1 AS k FROM frames WINDOW w AS (PARTITION BY package ORDER BY place, frame)),
known AS (SELECT package, frame, min(k) AS position, min(moment) AS media FROM ordered GROUP BY ALL),
placed AS MATERIALIZED (SELECT * FROM payloads LEFT JOIN known USING (package, frame)),
swept AS (SELECT m.*, coalesce(lag(m.offset + length) OVER (PARTITION BY package, segment ORDER BY place, m.offset, id), header) AS due FROM members m JOIN segments USING (package, segment)),
clo AS (SELECT package, id AS c, parent AS p FROM needs UNION SELECT clo.package, clo.c, n.parent FROM clo JOIN needs n ON n.package = clo.package AND n.id = clo.p),
turning AS (SELECT package, c FROM clo WHERE c = p)
""" + " UNION ALL ".join(rules)


#: Lines that a bucket of the packages is to have at most: what a task sorts of them, and of the samples they lack, stays in memory. At least, where the session has partitions for more.
MOST_LINES, LEAST_LINES = 1 << 19, 1 << 16
#: Up to so many buckets a task of lines writes into all of them; beyond, there would be too many files, and lines are shuffled by package first.
MOST_OPEN = 128


def package_buckets(lines: int, partitions: int) -> int:
    return max(1, -(-lines // MOST_LINES), min(partitions, -(-lines // LEAST_LINES)))


def package_tables(spark: SparkSession, sf_dir: str, scratch: Scratch, buckets: int) -> list[DataFrame]:
    """Frames, payloads, needs, segments and members, all read from frames and lines that are stored once, dealt by package."""
    orders, lineitem = (table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    # DuckDB's cast of a number to a whole one rounds, halves to the even one; Spark's cuts.
    whole = lambda text: re.sub(r"CAST\((o_totalprice|l_quantity) AS BIGINT\)", r"CAST(rint(\1) AS BIGINT)", text)
    frames = scratch.deal(spark.sql(whole(_FRAMES), orders=orders), "package", buckets)
    numbered = spark.sql(whole(_NUMBERED), lineitem=lineitem, frames=frames)
    lines = scratch.deal(numbered if buckets <= MOST_OPEN else numbered.repartition(buckets, "package"), "package", buckets)
    lines = lines.select("*", F.expr("frame * 100 + quality AS id"), F.expr("CAST(floor((place - 1) / 4) AS BIGINT) AS e"))
    return [frames, *(spark.sql(text, lines=lines) for text in (_PAYLOADS, _NEEDED, _SEGMENTS, _MEMBERS))]


@query(_package_sql())
def package_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's package of orders breaks of the rules of an index."""
    buckets = package_buckets(table(spark, sf_dir, "lineitem").count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with Scratch(spark) as scratch:
        return packages.package_index_faults(*package_tables(spark, sf_dir, scratch, buckets), epoch_frames=4, buckets=buckets)
