"""Queries of rollups, audits, validations and generated workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import metrics, relational, reports
from tidelake.registry import query
from tidelake.sources.tables import table

_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT)"


@query("""SELECT p_brand, round(avg(p_retailprice), 6) AS price_mean, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS price_weighted, round(quantile_cont(p_retailprice, 0.95), 6) AS price_p95, min(p_retailprice) AS price_worst,
round(avg(e), 6) AS e_mean, round(sum(e * p_size) / sum(p_size), 6) AS e_weighted, round(quantile_cont(e, 0.95), 6) AS e_p95, max(e) AS e_worst FROM (SELECT *, p_size / 10 AS e FROM part) GROUP BY p_brand""")
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics under four strategies, the second better when lower."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_retailprice").alias("price"), (F.col("p_size") / 10).alias("e"))
    out = reports.profile_rollup(parts, ["p_brand"], ["price", "e"], "p_size", ["e"])
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("SELECT l_shipmode_key AS l_suppkey, count(DISTINCT l_returnflag) AS n_variants, count(DISTINCT l_linenumber) AS n_members, count(*) = count(DISTINCT l_returnflag) * count(DISTINCT l_linenumber) AS same FROM (SELECT DISTINCT l_suppkey AS l_shipmode_key, l_returnflag, l_linenumber FROM lineitem) GROUP BY l_shipmode_key")
def same_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all return flags of a supplier occur with the same line numbers."""
    return reports.same_population(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_linenumber")


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount), 4) AS solo, round(sum(l_quantity * least(l_tax, l_discount)), 4) AS visible, round(CASE WHEN sum(l_quantity * l_discount) > 0 THEN 1 - sum(l_quantity * least(l_tax, l_discount)) / sum(l_quantity * l_discount) END, 6) AS occlusion FROM lineitem GROUP BY l_suppkey")
def visibility_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.least("l_tax", "l_discount"))
    out = reports.visibility_aggregate(lines, ["l_suppkey"], "l_quantity", "l_discount", "v")
    return out.select("l_suppkey", F.round("solo", 4).alias("solo"), F.round("visible", 4).alias("visible"), F.round("occlusion", 6).alias("occlusion"))


@query("SELECT p_brand, p_size, round(lag(e) OVER (PARTITION BY p_brand ORDER BY p_size) - e, 6) AS gain FROM (SELECT p_brand, p_size, avg(p_retailprice) AS e FROM part GROUP BY ALL)")
def gain_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of mean price from each size of a brand to the next."""
    means = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("e"))
    return reports.gain_by_step(means, ["p_brand"], "p_size", "e").select("p_brand", "p_size", F.round("gain", 6).alias("gain"))


@query("SELECT n, count(*) AS items, count(DISTINCT s) AS signatures FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s, len(s) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def incidence_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by how many priorities their orders have, and how many different sets of them there are."""
    s = reports.signatures(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return s.groupBy("n").agg(F.count("*").alias("items"), F.count_distinct("signature").alias("signatures"))


@query("""WITH pairs AS (SELECT DISTINCT s_nationkey AS item, l_partkey AS member FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
sets AS (SELECT member, list_sort(list(item)) AS s FROM pairs GROUP BY member), classes AS (SELECT s, row_number() OVER (ORDER BY min(member)) - 1 AS bit FROM sets GROUP BY s),
bits AS (SELECT DISTINCT item, bit FROM pairs JOIN sets USING (member) JOIN classes USING (s)),
bytes AS (SELECT item, bit // 8 AS k, CAST(sum(1 << CAST(bit % 8 AS INTEGER)) AS BIGINT) AS v, count(*) AS n FROM bits GROUP BY ALL),
rows AS (SELECT item, max(k) AS top, CAST(sum(n) AS BIGINT) AS n_classes FROM bytes GROUP BY item)
SELECT item AS s_nationkey, n_classes, string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY k) AS mask FROM (SELECT item, n_classes, unnest(range(0, top + 1)) AS k FROM rows) LEFT JOIN bytes USING (item, k) GROUP BY item, n_classes""")
def class_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation, as bits, the classes of parts that the same nations' suppliers have shipped."""
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return reports.class_masks(pairs, "s_nationkey", "l_partkey")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS clones FROM lineitem GROUP BY ALL")
def merged_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same alternative as one, their values added up."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("clones"))


@query("SELECT a.c_custkey FROM customer a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 11 <> 0) x USING (c_custkey) WHERE a.c_acctbal IS DISTINCT FROM x.b")
def differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance differs between two versions of the table, or that one lacks."""
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    b = a.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return reports.differing_rows(a, b, ["c_custkey"], ["c_acctbal"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d = 0 THEN 'repeated' ELSE 'gap' END AS kind FROM (SELECT l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem) WHERE d <> 1")
def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that repeat or skip."""
    return reports.sequence_faults(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(f"SELECT o_custkey, s, CASE WHEN s > p THEN 'gap' ELSE 'overlap' END AS kind FROM (SELECT o_custkey, s, lag(s + 60) OVER (PARTITION BY o_custkey ORDER BY s) AS p FROM (SELECT o_custkey, {_DAY.format('o_orderdate')} AS s FROM orders)) WHERE s <> p")
def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overlaps between a customer's 60-day intervals."""
    s = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("s")).withColumn("e", F.col("s") + 60)
    return reports.coverage_faults(s, ["o_custkey"], "s", "e")


@query("SELECT s_suppkey || '#' || k AS owner, sha256(s_suppkey || '#' || k || ':' || s_name) AS content, CAST(k AS INTEGER) AS copy FROM supplier, range(0, 3) r(k)")
def scaling_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each supplier under owners of their own."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("owner"), F.col("s_name").alias("content"))
    return reports.clones(s, 3, "owner", "content")


@query("SELECT l_suppkey, round(sum(l_discount * l_tax / nullif(l_quantity, 0) * (100 - l_linenumber)), 6) AS utility FROM lineitem GROUP BY l_suppkey")
def density_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = reports.density_utility(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.lit(100.0), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(u), 6).alias("utility"))


@query("SELECT source, CAST(sum(b) AS BIGINT) AS missing_bytes, count(*) AS n_missing FROM (SELECT source, sha256(text) AS h, max(n_chars) AS b FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY ALL) GROUP BY source")
def missing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source needs beyond the English texts, each text once."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return reports.missing_bytes(docs, docs.where("lang = 'en'"), ["source"], "h", "n_chars")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM events, range(0, 4) r(k) GROUP BY 1),
c AS (SELECT quantile_cont(mean, 1 / 3.0) AS m1, quantile_cont(mean, 2 / 3.0) AS m2, quantile_cont(variance, 1 / 3.0) AS v1, quantile_cont(variance, 2 / 3.0) AS v2 FROM w)
SELECT start, n, round(mean, 5) AS mean, CASE WHEN mean <= m1 THEN 'low' WHEN mean <= m2 THEN 'middle' ELSE 'high' END || '-' || CASE WHEN variance <= v1 THEN 'stable' WHEN variance <= v2 THEN 'middle' ELSE 'variable' END AS class FROM w, c""")
def window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows every six hours, sorted into thirds by mean and variance."""
    out = reports.window_classes(table(spark, sf_dir, "events"), "ts", "value", "1 day", "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 5).alias("mean"), "class")


@query("SELECT user_id, round(avg(value) * 100, 6) AS eta FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value) AS k FROM events) WHERE k <= 20 GROUP BY user_id")
def eta_from_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred tasks at the pace of the last twenty."""
    return reports.eta_seconds(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 100).select("user_id", F.round("eta", 6).alias("eta"))


@query("SELECT n_regionkey, min(s_acctbal) AS low, max(s_acctbal) AS high, min(s_suppkey) AS first_key, max(s_suppkey) AS last_key FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of boxes: least minima and greatest maxima on each axis."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.groupBy("n_regionkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"), F.min("s_suppkey").alias("first_key"), F.max("s_suppkey").alias("last_key"))


@query("SELECT o_custkey, count(DISTINCT l_partkey) AS resources, CAST(ceil(count(DISTINCT l_partkey) / 6) AS BIGINT) * 50 AS least_ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey".replace("/ 6)", "/ 6.0)"))
def latency_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least time for a customer's distinct parts with six slots of 50 ms."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    n = joined.groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("resources"))
    return n.withColumn("least_ms", (F.ceil(F.col("resources") / 6.0) * 50).cast("long"))


@query("SELECT l_linestatus, round(sum(s) FILTER (WHERE l_returnflag <> 'A'), 3) AS done_s, count(*) FILTER (WHERE l_returnflag = 'A') AS failed, bool_and(l_returnflag <> 'A') AS complete FROM (SELECT *, l_quantity * 0.5 AS s FROM lineitem) GROUP BY l_linestatus")
def job_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of tasks that succeeded, failures, and whether all are done."""
    ok = F.col("l_returnflag") != "A"
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.when(ok, F.col("l_quantity") * 0.5)), 3).alias("done_s"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("complete"))


@query("SELECT user_id, round(max(value), 4) AS peak, round(avg(value), 6) AS mean, count(*) AS samples FROM events GROUP BY user_id")
def sampling_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.max("value"), 4).alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("samples"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS cases, count(*) FILTER (WHERE g <= 0.5) AS feasible, round(max(g), 6) AS largest_gap, round(median(g), 6) AS median_gap FROM (SELECT *, abs(l_extendedprice - l_quantity * 1500) / l_extendedprice AS g FROM lineitem) GROUP BY ALL")
def discretisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative gaps of an estimate: how many cases are within half, the largest and the median."""
    g = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500) / F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", g.alias("g"))
    facts = [F.count("*").alias("cases"), F.count_if(F.col("g") <= 0.5).alias("feasible"), F.round(F.max("g"), 6).alias("largest_gap")]
    out = metrics.medians(rows, ["l_returnflag", "l_linestatus"], "g", facts)
    return out.select("l_returnflag", "l_linestatus", "cases", "feasible", "largest_gap", F.round("median", 6).alias("median_gap"))


@query("SELECT source, lang, count(*) AS markers, CAST(sum(n_chars) AS BIGINT) AS bytes, grouping(lang) = 1 AS whole FROM documents GROUP BY GROUPING SETS ((source, lang), (source))")
def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and language, and by source in all."""
    docs = table(spark, sf_dir, "documents")
    out = docs.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")]], "source", "lang").agg(F.count("*").alias("markers"), F.sum("n_chars").alias("bytes"), (F.grouping("lang") == 1).alias("whole"))
    return out


@query("SELECT (SELECT count(*) FROM nation) * (SELECT count(DISTINCT c_mktsegment) FROM customer) * (SELECT count(DISTINCT o_orderpriority) FROM orders) AS tasks")
def task_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a matrix of tasks from the sizes of its axes."""
    sizes = table(spark, sf_dir, "nation").agg(F.count("*").alias("a")), table(spark, sf_dir, "customer").agg(F.count_distinct("c_mktsegment").alias("b")), table(spark, sf_dir, "orders").agg(F.count_distinct("o_orderpriority").alias("c"))
    return sizes[0].join(sizes[1]).join(sizes[2]).select((F.col("a") * F.col("b") * F.col("c")).alias("tasks"))  # one row each


@query("SELECT a.conv_id, a.turn, a.role AS role, coalesce(b.role, 'none') AS expected FROM conversations a LEFT JOIN (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.role IS DISTINCT FROM b.role")
def expected_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role is not the one that their place gives."""
    expected = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return table(spark, sf_dir, "conversations").withColumn("expected", expected).where("role != expected").select("conv_id", "turn", "role", "expected")


@query("SELECT k AS segment, c_custkey FROM range(0, 4) r(k), customer WHERE (c_custkey + k) % 4 <> 0")
def bound_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows repeated for every segment of a timeline that they are on."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("segment"))
    return rows.where((F.col("c_custkey") + F.col("segment")) % 4 != 0).select("segment", "c_custkey")


@query("""WITH wanted AS (SELECT o_custkey, l_partkey, min(o_orderdate) AS first, min(o_orderkey) AS key, max(l_quantity) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey),
held AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY first, key, l_partkey ROWS UNBOUNDED PRECEDING) AS used FROM wanted) SELECT o_custkey, count(*) AS admitted, round(sum(size), 2) AS used FROM held WHERE used <= 200 GROUP BY o_custkey""")
def prefetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each customer will want, each once and in order of the first order for it, as long as a capacity of 200 lasts."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    wanted = joined.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderdate").alias("first"), F.min("o_orderkey").alias("key"), F.max("l_quantity").alias("size"))
    used = F.sum("size").over(Window.partitionBy("o_custkey").orderBy("first", "key", "l_partkey").rowsBetween(Window.unboundedPreceding, 0))
    return wanted.withColumn("used", used).where("used <= 200").groupBy("o_custkey").agg(F.count("*").alias("admitted"), F.round(F.sum("size"), 2).alias("used"))


@query("SELECT l_partkey AS key FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rows that a second run does not give as often: sales of each part beyond the first."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).exceptAll(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))


@query("SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN 'override' ELSE 'default' END AS chosen FROM part")
def manual_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default choice unless an override is given."""
    parts = table(spark, sf_dir, "part")
    override = parts.where("p_size > 25").select("p_partkey", F.lit("override").alias("o"))
    out = relational.lookup(parts.select("p_partkey", "p_brand"), override, ["p_partkey"], ["o"])
    return out.select("p_partkey", "p_brand", F.coalesce("o", F.lit("default")).alias("chosen"))
