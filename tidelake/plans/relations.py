"""Queries over joins, sets and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import neighbours
from tidelake.operators import relational as r
from tidelake.registry import query
from tidelake.sources.tables import table


@query("SELECT doc_id, coalesce(toxic, -1) AS toxic, CASE WHEN toxic IS NULL THEN 'not found' ELSE '' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, or why there is none."""
    out = r.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], ["toxic"])
    return out.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT l_partkey, l_suppkey, n_name, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'R' GROUP BY ALL")
def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned quantity by part and supplier, with the supplier's nation."""
    sums = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return sums.join(where, "l_suppkey").select("l_partkey", "l_suppkey", "n_name", "quantity")


@query("SELECT doc_id AS key, 'no label' AS missing FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) UNION ALL SELECT p_partkey, 'never sold' FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def missing_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels and parts never sold."""
    a = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("key"), F.lit("no label").alias("missing"))
    b = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("p_partkey").alias("key"), F.lit("never sold").alias("missing"))
    return a.unionByName(b)


@query("SELECT r_name, m AS c_mktsegment, p AS o_orderpriority, count(o_orderkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) LEFT JOIN (SELECT n_regionkey, c_mktsegment, o_orderpriority, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey) x ON x.n_regionkey = r_regionkey AND x.c_mktsegment = m AND x.o_orderpriority = p GROUP BY ALL")
def case_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region, segment and priority with its orders, 0 for cases without one; the axes are a handful of values each."""
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    axes = table(spark, sf_dir, "region").crossJoin(customer.select("c_mktsegment").distinct()).crossJoin(orders.select("o_orderpriority").distinct())
    done = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return axes.join(done, ["r_regionkey", "c_mktsegment", "o_orderpriority"], "left").select("r_name", "c_mktsegment", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n"))


_NATION_SALES = "(SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = '{}' GROUP BY n_name)"


@query(f"SELECT n_name, a.revenue AS base_revenue, b.revenue AS other_revenue, round(b.revenue - a.revenue, 2) AS delta_revenue FROM {_NATION_SALES.format('A')} a JOIN {_NATION_SALES.format('R')} b USING (n_name)")
def paired_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' revenue under two return flags and the difference."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    part = lambda f: joined.where(F.col("l_returnflag") == f).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return r.paired(part("A"), part("R"), ["n_name"], ["revenue"]).withColumn("delta_revenue", F.round("delta_revenue", 2))


@query("SELECT p_partkey, p_brand FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def pareto_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no part of the brand beats in price and size."""
    return r.pareto_2d(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_partkey", "p_brand")


@query("SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal < b.s_acctbal + 500 AND b.s_acctbal < a.s_acctbal + 500")
def close_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose balance ranges of 500 overlap."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    return r.overlapping_pairs(s, ["s_nationkey"], "s_suppkey", "lo", "hi", 500.0)


@query("SELECT query, item, CAST(k AS INTEGER) AS rank, round(d, 4) AS distance FROM (SELECT q.vec_id AS query, v.vec_id AS item, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE k <= 5")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    out = r.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 5)
    return out.select("query", "item", "rank", F.round("distance", 4).alias("distance"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c.conv_id, c.turn - 1 AS p, c.turn AS c FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1), t AS (SELECT conv_id, p AS ancestor, c AS node, 1 AS depth FROM e UNION SELECT t.conv_id, t.ancestor, e.c, t.depth + 1 FROM t JOIN e ON e.conv_id = t.conv_id AND e.p = t.node) SELECT conv_id, ancestor, node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY ALL")
def reply_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns that each turn of a conversation leads to."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"))
    edges = c.join(parent, ["conv_id", "turn"], "left_semi").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent"), F.struct("conv_id", "turn").alias("node"))
    out = r.closure(edges, "parent", "node")
    return out.select("ancestor.conv_id", F.col("ancestor.turn").alias("ancestor"), F.col("node.turn").alias("node"), "depth")


_SPANS = "(SELECT greatest(max(p_size) - min(p_size), 10)::DOUBLE AS s1, greatest(max(ln(p_retailprice)) - min(ln(p_retailprice)), 0.5) AS s2, greatest(max(p_partkey % 360) - min(p_partkey % 360), 90)::DOUBLE AS s3 FROM part)"


@query(f"""WITH q AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS x, ln(900 + abs(s_acctbal) / 10) AS y, CAST(s_suppkey * 7 % 360 AS DOUBLE) AS z FROM supplier),
d AS (SELECT s_suppkey, p_partkey, sqrt((abs(p_size / s1 - x / s1)) ** 2 + (abs(ln(p_retailprice) / s2 - y / s2)) ** 2 + least(abs(p_partkey % 360 / s3 - z / s3), 360 / s3 - abs(p_partkey % 360 / s3 - z / s3)) ** 2) AS d FROM q, part, {_SPANS})
SELECT s_suppkey AS query, p_partkey AS item, CAST(k AS INTEGER) AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(d, 12), p_partkey) AS k FROM d) WHERE k <= 4""")
def nearest_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts nearest to each supplier in size, in price as a ratio and in an angle, each in spans of the parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 360).alias("z"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("x"), (900 + F.abs("s_acctbal") / 10).alias("y"), (F.col("s_suppkey") * 7 % 360).alias("z"))
    (items, queries), periods = neighbours.on_axes(p, {"x": ("linear", 10.0), "y": ("log", 0.5), "z": (360.0, 90.0)}, s)
    out = neighbours.nearest_pruned(queries, items, "s_suppkey", "p_partkey", "__at", 4, periods, same=False)
    return out.select("query", "item", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT conv_id, turn, role FROM conversations a WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role <> a.role)")
def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose parent turn is there and of another role."""
    c = table(spark, sf_dir, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    return c.join(parent, ["conv_id", "turn"]).where("role != before").select("conv_id", "turn", "role").distinct()


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part) WHERE k = 1")
def best_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dearest part of each brand; ties go to the smaller size, then the smaller key."""
    return r.best(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts with the first document and how often they occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return r.dedup_counted(docs, ["digest"], "doc_id")


@query("SELECT p_brand, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS k FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)) WHERE k <= 3")
def top_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest sizes of each brand, ties included."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    k = F.rank().over(Window.partitionBy("p_brand").orderBy(F.col("n").desc()))
    return counts.withColumn("k", k).where("k <= 3").select("p_brand", "p_size")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'P'")
def job_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders in a full order; places come from range partitions' counts, so no task sorts them all."""
    from tidelake.operators.storage import global_row_number

    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return global_row_number(jobs, ["o_orderpriority", "o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS both_sides, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS only_first, CAST(sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS only_second, l_shipyear FROM (SELECT l_shipyear, l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM (SELECT date_part('year', l_shipdate) AS l_shipyear, * FROM lineitem) GROUP BY ALL) GROUP BY l_shipyear")
def resource_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and differences of two sets of parts, by year, in one grouping."""
    flags = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("l_shipyear"), "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    return flags.groupBy("l_shipyear").agg(F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"))


@query("""WITH d AS (SELECT c_nationkey, c_custkey, CAST(greatest(round(c_acctbal * 100), 0) AS BIGINT) AS d FROM customer),
l AS (SELECT *, 2000003 - coalesce(sum(d) OVER w, 0) AS r, count(*) OVER (PARTITION BY c_nationkey) - coalesce(count(d) OVER w, 0) AS n FROM d WINDOW w AS (PARTITION BY c_nationkey ORDER BY d, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT c_nationkey, min(d) AS f, arg_min(r, (d, -n)) AS r, arg_min(n, (d, -n)) AS n FROM l WHERE d * n > r GROUP BY c_nationkey)
SELECT c_nationkey, c_custkey, CAST(CASE WHEN f IS NULL OR d < f THEN d ELSE s.r // s.n + CASE WHEN row_number() OVER (PARTITION BY c_nationkey, d >= f ORDER BY c_custkey) <= s.r % s.n THEN 1 ELSE 0 END END AS BIGINT) AS granted FROM d LEFT JOIN s USING (c_nationkey)""")
def fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000.03 a nation shared in whole cents among its customers' demands."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.greatest(F.round(F.col("c_acctbal") * 100), F.lit(0.0)).cast("long").alias("d"))
    return r.fair_share(c, ["c_nationkey"], "c_custkey", "d", 2000003).select("c_nationkey", "c_custkey", "granted")


@query("SELECT c_custkey AS id, c_name AS name, -1 AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def heterogeneous_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two shapes under the union of their columns."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True).fillna(-1, ["size"])
