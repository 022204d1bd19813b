"""Merkle manifest of a dataset: one tree a group, and one tree over the groups' roots.

The tree is built from the bottom: nodes of a level stand in pages of `arity` ** `height`
consecutive ones, one row a page, which holds the `height` levels above them too; the
tops of the pages are the nodes of the next table. Every table is written to the shared
folder, so a lost executor costs a page and not the tree. Proofs are pushed from the top:
a page joins the page above it by its place there, and each of its nodes prepends its own
siblings to the proof that the page inherits. A group of any size is split by its pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ensure_checkpoint_dir

#: What a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A proof has a step a level, from the leaf to the root: the run's digests on both sides of one's own.
PROOF = "array<struct<left:string,right:string>>"


def digest(*inputs: Column) -> Column:
    """H: the lowercase hex SHA-256 of the inputs one after another."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if null, else the bytes in UTF-8, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))


def numbered(leaves: DataFrame, scratch: Scratch, order: Sequence[str]) -> DataFrame:
    """leaves with their place in their tree, from 0, and the tree's size n. Rows are dealt by ranges of (tree, order), so no tree meets in one task."""
    dealt = scratch.store(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    parts = parts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    local = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return dealt.withColumn("local", local).join(parts, ["tree", "part"]).withColumn("place", F.col("local") + F.col("ahead")).drop("part", "local", "ahead")


def _above(nodes: Column, arity: int) -> Column:
    """The next level: the digest of each run of `arity` nodes; the last may have fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(nodes, k * arity + 1, F.lit(arity)), "")))


def _levels_of(n: Column, arity: int, height: int) -> Column:
    """How many levels lie above n nodes of one page, at most `height`."""
    return reduce(lambda c, h: c.when(n <= arity**h, h), range(1, height), F.when(n <= 1, 0)).otherwise(height)


def build(nodes: DataFrame, scratch: Scratch, arity: int = 2, height: int = 6) -> tuple[list[DataFrame], DataFrame]:
    """Tables of pages, lowest first, and (tree, top) of every tree.

    nodes: tree, place (from 0), n (of the tree), digest and what else their rows carry.
    """
    if arity < 2 or height < 1:
        raise ValueError("arity must be 2 or more, height 1 or more")
    width, tables, tops = arity**height, [], []
    carried = [c for c in nodes.columns if c not in ("tree", "n", "place", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        item = F.struct("place", "digest", *carried)
        pages = nodes.groupBy("tree", F.floor(F.col("place") / width).alias("page")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
        steps = _levels_of(F.col("n"), arity, height)
        first = F.array(F.transform("items", lambda x: x["digest"]))
        up = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        levels = F.aggregate(up, first, lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1), arity))))
        tables.append(scratch.store(pages.withColumn("levels", levels).withColumn("top", F.element_at("levels", -1)[0])))
        tops.append(tables[-1].where(F.col("n") <= width).select("tree", "top"))
        nodes = tables[-1].where(F.col("n") > width).select("tree", F.col("page").alias("place"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("digest"))
        carried, most = [], -(-most // width) if most > width else 0
    return tables, reduce(DataFrame.unionByName, tops) if tops else nodes.select("tree", F.col("digest").alias("top"))


def push(tables: Sequence[DataFrame], seeds: DataFrame, arity: int = 2, height: int = 6) -> DataFrame:
    """The rows of the lowest nodes with their proofs, and all columns of seeds: one row a tree, with the `proof` that its top inherits."""
    width, given, inherited = arity**height, [c for c in seeds.columns if c not in ("tree", "proof")], None
    for k in reversed(range(len(tables))):
        pages = tables[k].drop("top")
        both = pages.where(F.col("n") <= width).join(seeds, "tree")
        if inherited is not None:
            both = both.unionByName(pages.where(F.col("n") > width).join(inherited.withColumnRenamed("place", "page"), ["tree", "page"]))

        def step(level: Column, at: Column) -> Column:
            """Left and right siblings at a level of the node that stands at `at` of it."""
            left = at % arity
            side = lambda start, count: F.array_join(F.slice(level, start, count), "")
            return F.struct(side((at - left + 1).cast("int"), left.cast("int")).alias("left"), side((at + 2).cast("int"), (arity - 1 - left).cast("int")).alias("right"))

        own = lambda x: F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda level, h: step(level, F.floor((x["place"] - F.col("page") * width) / F.pow(F.lit(arity), h)).cast("long")))
        nodes = F.transform("items", lambda x: F.struct(x.alias("node"), F.concat(own(x), F.col("proof")).cast(PROOF).alias("proof")))
        out = both.select("tree", *given, F.explode(nodes).alias("x")).select("tree", *given, "x.node.*", "x.proof")
        inherited = out.select("tree", "place", "proof", *given)
    return out


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, also: Sequence[Column] = (), arity: int = 2, height: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof and the columns of `also`, one row a row of docs.

    Leaves of equal `order` follow each other by digest, null first; whole repeated rows
    are leaves of their own. A null group is a tree too, and comes first. Texts are hashed
    where they are read, however long, and not moved; other columns of docs do not matter.
    An empty table has no root and no rows. The result reads tables of scratch.
    """
    kept = docs.select(F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"), F.col(order).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), *also)
    names = kept.columns[3:]
    leaves = numbered(scratch.store(kept), scratch, ["key", "digest"])
    tables, subroots = build(leaves, scratch, arity, height)
    if not tables:
        return kept.select(F.col("key").alias(order), F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"), *names)
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("digest"))
    upper, tops = build(numbered(forest, scratch, ["group"]), scratch, arity, height)
    seeds = push(upper, tops.select("tree", F.col("top").alias("root"), F.array().cast(PROOF).alias("proof")), arity, height)
    seeds = scratch.store(seeds.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "proof"))
    return push(tables, seeds, arity, height).select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof", *names)


def proof_digest(proof: Column) -> Column:
    """H of all siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def audit(docs: DataFrame, tampered: Column, changed: dict[str, Column], **how) -> DataFrame:
    """The manifest of docs held against changed rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `tampered` holds, fields are as `changed` says; everywhere a leaf and the
    original siblings are folded to folded_root. Null ids: see manifest().
    """
    other = F.when(tampered, leaf([changed.get(f, F.col(f)) for f in how.get("fields", FIELDS)])).alias("other")
    ensure_checkpoint_dir(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        rows = manifest(docs, also=[other], scratch=scratch, **how)
        out = rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("proof")))
        key = rows.columns[0]
        return out.select(key, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")).checkpoint()


#: CRC-32 in DuckDB SQL of the decimal text of an integer.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: list_reduce(list_prepend(xor(h, c), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END))"


def oracle(arity: int = 2) -> str:
    """DuckDB SQL for audit() as op11 applies it."""
    one = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda n: "sha256(" + " || ".join(one(n if c == "n_chars" else c) for c in FIELDS) + ")"
    above = f"list_transform(range((len(d) + {arity - 1}) // {arity}), lambda k: sha256(array_to_string(d[k * {arity} + 1 : k * {arity} + {arity}], '')))"
    side = lambda d, at: f"array_to_string(list_slice({d}, {at} // {arity} * {arity} + 1, {at}), '') AS l, array_to_string(list_slice({d}, {at} + 2, {at} // {arity} * {arity} + {arity}), '') AS r"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {row('n_chars')} AS leaf, {row('n_chars + 1')} AS other,
    CASE WHEN doc_id IS NULL THEN false ELSE xor({_CRC}, 4294967295::BIGINT) % 7 = 0 END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
levels AS (
  SELECT 0 AS h, lang, list(leaf ORDER BY p) AS d FROM placed GROUP BY lang
  UNION ALL
  SELECT h + 1, lang, {above} FROM levels WHERE len(d) > 1),
subroots AS (SELECT lang, d[1] AS subroot, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM levels WHERE len(d) = 1),
upper AS (
  SELECT 0 AS h, list(subroot ORDER BY q) AS d FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT h + 1, {above} FROM upper WHERE len(d) > 1),
root AS (SELECT d[1] AS root FROM upper WHERE len(d) = 1),
steps AS (
  SELECT x.doc_id, x.leaf, x.p, x.lang, l.h AS h, {side('l.d', f'(x.p // CAST({arity} ** l.h AS BIGINT))')}
  FROM placed x JOIN levels l ON l.lang IS NOT DISTINCT FROM x.lang AND len(l.d) > 1
  UNION ALL
  SELECT x.doc_id, x.leaf, x.p, x.lang, s.h + u.h, {side('u.d', f'(s.q // CAST({arity} ** u.h AS BIGINT))')}
  FROM placed x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang JOIN upper u ON len(u.d) > 1),
proofs AS (SELECT lang, p, list(struct_pack(l := l, r := r) ORDER BY h) AS proof FROM steps GROUP BY lang, p)
SELECT x.doc_id, x.leaf, s.subroot, root.root, sha256(array_to_string(list_transform(coalesce(f.proof, []), lambda t: t.l || t.r), '')) AS proof_sha256, folded AS folded_root, folded = root.root AS verified
FROM placed x JOIN subroots s ON s.lang IS NOT DISTINCT FROM x.lang CROSS JOIN root LEFT JOIN proofs f ON f.lang IS NOT DISTINCT FROM x.lang AND f.p = x.p,
LATERAL (SELECT CASE WHEN x.tampered AND x.other IS NOT NULL THEN x.other ELSE x.leaf END AS begun),
LATERAL (SELECT coalesce(list_reduce(list_prepend(struct_pack(l := '', r := begun), f.proof), lambda a, t: struct_pack(l := '', r := sha256(t.l || a.r || t.r))).r, begun) AS folded)"""
