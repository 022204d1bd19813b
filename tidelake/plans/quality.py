"""Queries over measurements: distributions, pooled errors, rankings, rollups, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import metrics as m
from tidelake.registry import query
from tidelake.sources.tables import table


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*m.distribution("value"))
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "low", "high")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.95) AS nearest_p95 FROM events GROUP BY event_type")
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles."""
    out = m.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": ("interpolated", 0.5), "p95": ("interpolated", 0.95), "nearest_p95": ("nearest", 0.95)})
    return out.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("SELECT event_type, l[CAST(least(len(l) - 1, floor(len(l) * 0.95)) AS BIGINT) + 1] AS lower_p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type)")
def lower_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.lower_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "lower_p95")


@query("SELECT user_id, round(count(*) / sum(1 / value), 6) AS harmonic FROM events WHERE value > 0 GROUP BY user_id")
def harmonic_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value > 0").groupBy("user_id").agg(F.round(m.harmonic_mean("value"), 6).alias("harmonic"))


@query("""SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (WHERE l_quantity > 0) AS n_measured, round(10 * log10(sum(l_quantity) / sum(power(l_discount, 2))), 6) AS psnr_db,
round(avg(CASE WHEN l_discount > 0 THEN 10 * log10(l_quantity / power(l_discount, 2)) END), 6) AS mean_psnr_db FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def pooled_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as errors, quantities as sample counts: the pooled figure beside the mean of decibels."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("sse", F.pow("l_discount", F.lit(2)))
    out = m.pooled_quality(joined, ["o_orderpriority"], "sse", "l_quantity")
    return out.select("o_orderpriority", "n_rows", "n_measured", F.round("psnr_db", 6).alias("psnr_db"), F.round("mean_psnr_db", 6).alias("mean_psnr_db"))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS uniform, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS weighted, round(median(p_retailprice), 6) AS mid, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, min(p_retailprice) AS worst FROM part GROUP BY p_brand")
def named_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda s: F.round(m.aggregate(s, "p_retailprice", "p_size"), 6)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(a("uniform_mean").alias("uniform"), a("weighted_mean").alias("weighted"), a("median").alias("mid"), a("p95").alias("p95"), m.aggregate("worst", "p_retailprice").alias("worst"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n_over, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, round(sum(greatest(o_totalprice - 200000, 0)), 2) AS overrun FROM orders GROUP BY o_orderstatus")
def conditional_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.col("o_totalprice") - 200000
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(over > 0).alias("n_over"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.round(F.sum(F.greatest(over, F.lit(0.0))), 2).alias("overrun"))


@query("SELECT user_id, coalesce(round(sum(value) FILTER (WHERE event_type = 'click'), 4), 0) AS click, coalesce(round(sum(value) FILTER (WHERE event_type = 'purchase'), 4), 0) AS purchase, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def traffic_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by kind and in all."""
    by = lambda k: F.coalesce(F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 4), F.lit(0.0)).alias(k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(by("click"), by("purchase"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT source, CAST(sum(n) AS BIGINT) AS distinct_chars FROM (SELECT source, sha256(text), max(n_chars) AS n FROM documents GROUP BY ALL) GROUP BY source")
def distinct_text_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a source's different texts."""
    docs = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("h"), "n_chars")
    return m.distinct_sum(docs, ["source"], "h", "n_chars", "distinct_chars")


_SUPPLIERS = "(SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) / 30000 AS r, any_value(n_regionkey) AS region FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY l_suppkey)"


@query(f"""SELECT region, round(avg(abs(q - r)), 6) AS mae, round(sqrt(avg((q - r) * (q - r))), 6) AS rmse, round(avg(q - r), 6) AS bias, round(corr(a, b), 6) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY region ORDER BY q) + (count(*) OVER (PARTITION BY region, q) - 1) / 2 AS a, rank() OVER (PARTITION BY region ORDER BY r) + (count(*) OVER (PARTITION BY region, r) - 1) / 2 AS b FROM {_SUPPLIERS}) GROUP BY region""")
def supplier_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of suppliers' ranks by quantity and by revenue, by region."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), (F.sum("l_extendedprice") / 30000).alias("r"))
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region"))
    out = m.ranking_agreement(sums.join(where, F.col("l_suppkey") == F.col("s_suppkey")), ["region"], "q", "r")
    return out.select("region", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "spearman")])


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, CAST(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS grain
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name, c_mktsegment), (r_name), ())""")
def balance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances at four grains in one pass."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sets = [["r_name", "n_name"], ["r_name", "c_mktsegment"], ["r_name"], []]
    grouped = joined.groupingSets([[F.col(c) for c in s] for s in sets], "r_name", "n_name", "c_mktsegment")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id("r_name", "n_name", "c_mktsegment").cast("long").alias("grain"))


@query("SELECT p_partkey, round((best - p_retailprice) / abs(best) * 100, 6) AS gap_percent FROM (SELECT *, max(p_retailprice) FILTER (WHERE p_size <= 25) OVER (PARTITION BY p_brand) AS best FROM part)")
def gap_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap of each part's price to the best among small parts of its brand."""
    best = F.max(F.when(F.col("p_size") <= 25, F.col("p_retailprice"))).over(Window.partitionBy("p_brand"))
    return table(spark, sf_dir, "part").withColumn("b", best).select("p_partkey", F.round(-m.relative_error(F.col("p_retailprice"), F.col("b")) * 100, 6).alias("gap_percent"))


@query("""SELECT sha256(string_agg(p, '' ORDER BY b)) AS fingerprint FROM (SELECT b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM (SELECT h, CAST('0x' || substr(h, 1, 3) AS INTEGER) AS b FROM
(SELECT sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation)) GROUP BY b)""")
def nation_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digest of a table."""
    return m.fingerprint(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT l_returnflag, round(stddev_samp(l_discount), 8) AS sd, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(quantile_cont(l_discount, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def attribute_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_discount"), 8).alias("sd"), F.round(F.avg((F.col("l_discount") == 0).cast("double")), 6).alias("zero_share"), F.round(m.interpolated_percentile("l_discount", 0.95), 6).alias("p95"))


@query("SELECT user_id, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p5, round(max(p - value), 6) AS largest_drop, round(min(w), 6) AS least_mean5 FROM (SELECT user_id, value, lag(value) OVER o AS p, CASE WHEN count(*) OVER o5 = 5 THEN avg(value) OVER o5 END AS w FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), o5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY user_id")
def trace_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor, mean, fifth percentile, largest one-step drop and least five-event mean of each user's series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    five = w.rowsBetween(-4, 0)
    steps = table(spark, sf_dir, "events").select("user_id", "value", (F.lag("value").over(w) - F.col("value")).alias("d"), F.when(F.count("*").over(five) == 5, F.avg("value").over(five)).alias("m"))
    return steps.groupBy("user_id").agg(F.round(F.min("value"), 6).alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.05), 6).alias("p5"), F.round(F.max("d"), 6).alias("largest_drop"), F.round(F.min("m"), 6).alias("least_mean5"))


@query("SELECT l_shipmonth, round(sum(p * q) / nullif(sum(q), 0), 6) AS proxy FROM (SELECT date_part('month', l_shipdate) AS l_shipmonth, l_extendedprice AS p, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS q FROM lineitem) GROUP BY l_shipmonth".replace("l_shipmonth", "ship_month"))
def weighted_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean that is null where all weights are zero."""
    q = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").cast("long").alias("ship_month"), F.col("l_extendedprice").alias("p"), q.alias("q"))
    return rows.groupBy("ship_month").agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("q")), F.sum("q")), 6).alias("proxy"))


@query("""SELECT 'order without customer' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'discount out of range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1 UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unsafe url', count(*) FROM pages WHERE NOT regexp_matches(url, '^https?://[A-Za-z0-9.-]+(/[A-Za-z0-9._~%/?=&#-]*)?$') UNION ALL SELECT 'length mismatch', count(*) FROM documents WHERE n_chars <> length(text)""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of referential, range, key, pattern and accounting rules."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rules = {
        "order without customer": orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "discount out of range": lines.where("l_discount < 0 OR l_discount > 1"),
        "repeated line": lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "unsafe url": table(spark, sf_dir, "pages").where(~F.col("url").rlike(r"^https?://[A-Za-z0-9.-]+(/[A-Za-z0-9._~%/?=&#-]*)?$")),
        "length mismatch": table(spark, sf_dir, "documents").where(F.col("n_chars") != F.length("text")),
    }
    out = None
    for rule, bad in rules.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
