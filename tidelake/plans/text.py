"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import scalars as f
from tidelake.functions.strict import strict_json
from tidelake.registry import query
from tidelake.sources.tables import table


@query("SELECT event_id, format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS clock, 'PT' || regexp_replace(CAST(CAST(value AS DECIMAL(20, 6)) AS VARCHAR), '\\.?0+$', '') || 'S' AS duration FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS s FROM events)")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock and ISO duration texts."""
    return table(spark, sf_dir, "events").select("event_id", f.clock_text(F.floor(F.col("value") * 100)).alias("clock"), f.iso_duration(F.col("value")).alias("duration"))


@query("SELECT s_suppkey, round(((s_acctbal - 90 + 180) - 360 * floor((s_acctbal - 90 + 180) / 360)) - 180, 4) AS turn, round(s_acctbal - 30 * floor(s_acctbal / 30), 4) AS content_time FROM supplier")
def periodic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest turns and looped times."""
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(f.angle_difference(b, F.lit(90.0)), 4).alias("turn"), F.round(f.looped_time(b, 30.0), 4).alias("content_time"))


_UNIT = "CAST('0x' || substr(sha256('7:' || c_custkey || ':{}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT c_custkey, round((1 + sin(2 * pi() * (c_nationkey / (5 + 25 * {_UNIT.format('period')}) + {_UNIT.format('phase')}))) / 2, 6) AS weight FROM customer")
def synthetic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic weights from hashes of keys."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(f.synthetic_weight(F.col("c_custkey"), F.col("c_nationkey"), 7), 6).alias("weight"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '^https?://') AS absolute, sha256(html) AS digest FROM pages")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, scheme check and content digest of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").rlike("^https?://").alias("absolute"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query("SELECT p_partkey, CAST(round((least(greatest(p_retailprice, 900), 2000) - 900) / 1100 * 255) AS INTEGER) AS code, round(CAST(round((least(greatest(p_retailprice, 900), 2000) - 900) / 1100 * 255) AS INTEGER) / 255 * 1100 + 900, 6) AS decoded FROM part")
def quantised_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-bit codes of prices and back."""
    code = f.quantised(F.col("p_retailprice"), 900.0, 2000.0, 8)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), F.round(f.dequantised(code, 900.0, 2000.0, 8), 6).alias("decoded"))


@query("SELECT l_orderkey, round(list_product(list_transform(list(l_discount), lambda x: 1 - x)), 8) AS passed, round(sum(least(greatest(l_tax, 0), l_discount)), 6) AS visible, count(*) FILTER (WHERE l_discount <= 0.000001) AS hidden FROM lineitem GROUP BY l_orderkey")
def layered_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transmittance of an order's discounts as layers, and visibility of taxes within them."""
    v = f.visibility(F.col("l_tax"), F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", v.alias("v"))
    return rows.groupBy("l_orderkey").agg(F.round(f.transmittance(F.collect_list("l_discount")), 8).alias("passed"), F.round(F.sum("v.visible"), 6).alias("visible"), F.count_if(F.col("v.out_of_view")).alias("hidden"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'unavailable' AS missing, printf('%.2f', value) AS shown FROM events")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of nested JSON, and numbers as text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), f.available(F.lit(None).cast("double"), 2).alias("missing"), f.available(F.col("value"), 2).alias("shown"))


@query("""SELECT s_suppkey, sha256('{"owner":' || s_suppkey || ',"policy":"isolated","sha":"' || sha256(s_name) || '"}') AS namespaced, '{"id":' || s_suppkey || ',"nation":' || s_nationkey || '}' AS frame_key FROM supplier""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys from canonical JSON of sorted columns, and hashes kept apart by owner."""
    own = F.to_json(F.struct(F.col("s_suppkey").alias("owner"), F.lit("isolated").alias("policy"), F.sha2(F.col("s_name").cast("binary"), 256).alias("sha")))
    key = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(own.cast("binary"), 256).alias("namespaced"), key.alias("frame_key"))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2)) / len(a.embedding), 6) AS mse FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of each vector against the next."""
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(f.array_mse(F.col("embedding"), F.col("b")), 6).alias("mse"))


#: Event properties, some of which are made wrong in one way each.
_PROPS = "CASE event_id % 8 WHEN 1 THEN replace(props, '}', ', \"k\": 1}') WHEN 2 THEN '{\"k\": NaN}' WHEN 3 THEN concat(props, ' x') WHEN 4 THEN concat(props, ',', props) WHEN 5 THEN NULL WHEN 6 THEN rpad(props, 100, ' ') ELSE props END"


@query(f"""SELECT event_id, CASE WHEN event_id % 8 IN (0, 7) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 8 = 5 THEN 'missing' WHEN event_id % 8 = 6 THEN 'too long' WHEN event_id % 8 BETWEEN 1 AND 4 THEN 'malformed' END AS fault FROM (SELECT event_id, props, {_PROPS} AS text FROM events)""")
def strict_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of each event's properties, or why they are no strict JSON: a name twice, NaN, something after the end, too many bytes."""
    e = table(spark, sf_dir, "events").select("event_id", strict_json(F.expr(_PROPS), 64).alias("j"))
    return e.select("event_id", F.try_variant_get("j.value", "$.k", "bigint").alias("k"), "j.fault")


#: Paths of pages, most of which leave their root in one way each.
_PATH = "CASE page_id % 9 WHEN 0 THEN concat('a/', page_id, '.html') WHEN 1 THEN concat('../', page_id) WHEN 2 THEN concat('a/%2e%2e/', page_id) WHEN 3 THEN concat('a/%252e%252e/', page_id) WHEN 4 THEN concat('/', page_id) WHEN 5 THEN concat('a//', page_id) WHEN 6 THEN concat('a', chr(92), page_id) WHEN 7 THEN concat('a/./', page_id) ELSE concat('b/c..d/', page_id) END"


@query("SELECT page_id, page_id % 9 IN (0, 8) AS safe FROM pages")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths stay below their root, escapes of escapes included."""
    return table(spark, sf_dir, "pages").select("page_id", f.safe_relative_path(F.expr(_PATH)).alias("safe"))


@query("SELECT p_partkey, " + ", ".join(f"CAST(round((least(greatest(p_retailprice, 900), 2000) - 900) / 1100 * {2**b - 1}) AS INTEGER) AS q{b}" for b in (8, 12, 16)) + " FROM part")
def quantised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of prices of eight, twelve and sixteen bits."""
    return table(spark, sf_dir, "part").select("p_partkey", *[f.quantised(F.col("p_retailprice"), 900.0, 2000.0, b).alias(f"q{b}") for b in (8, 12, 16)])
