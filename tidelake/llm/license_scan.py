"""License scans by canonical digests.

Texts are brought to a canonical form (lower case, no copyright lines, one space for
anything between letters and digits, one spelling where several are usual), and the
digest of the whole form is looked up among those of known licences by a hash join.
A document counts as a whole, and so does each of its lines, as a notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, let
from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: A line that begins with a copyright mark, marks before it aside.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*"
BETWEEN = r"[^\p{L}\p{N}\n]+"
#: Known texts that may be sent to every executor; more are joined by a shuffle.
BROADCAST_LICENSES = 10_000


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have a word, in order."""
    form = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1"), BETWEEN, " ")
    form = F.concat(F.lit(" "), F.replace(form, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        form = F.replace(form, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.filter(F.transform(F.split(form, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(line: Column) -> Column:
    return F.sha2(F.regexp_replace(line, " +", " ").cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the texts and notices known here."""
    rows = [*TEXTS.items(), *((k, n) for k, ns in NOTICES.items() for n in ns)]
    return spark.createDataFrame(rows, "license string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, text_license, n_notices and notices of every document.

    digest is of the whole canonical text; text_license is the licence with that
    digest, else null (of several the first by name). n_notices counts lines, each
    time they occur, that are a whole known text by themselves, and notices lists
    their licences once, in order, comma-joined ("" for none). Null or empty text:
    the digest of nothing. Copies of a row are judged each by itself, but rows of
    equal id and text share their lines' count. Very long texts are read whole. licenses: (license, text), by
    default those known here; rows with nulls are passed over.
    """
    spark, lines = docs.sparkSession, canonical_lines(F.col("text"))
    given = (licenses if licenses is not None else known_licenses(spark)).select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).dropna()
    known = given.select("license", digest(F.array_join(lines, " ")).alias("known"))
    if licenses is None:
        known = known.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license string, known string"))
    known = known.groupBy("known").agg(F.min("license").alias("license"))
    if known.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES:
        known = F.broadcast(known)
    # One pass over a text: its digest, and as rows that digest and those of its lines.
    row = lambda d: lambda x, i: F.struct(d.alias("digest"), x.alias("known"), (i == 0).alias("whole"))
    digests = let(lines, lambda x: let(digest(F.array_join(x, " ")), lambda d: F.transform(F.concat(F.array(d), F.transform(x, digest)), row(d))))
    each = keyed_text(docs, id_col, text_col).select("doc_id", F.explode(digests).alias("e")).select("doc_id", "e.digest", "e.known", "e.whole")
    found = each.join(known, "known", "left").where("whole or license is not null")
    sums = found.groupBy("doc_id", "digest").agg(
        F.count_if("whole").alias("copies"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.count_if(~F.col("whole")).alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
    )
    out = sums.select("doc_id", "digest", "text_license", (F.col("n") / F.col("copies")).cast("long").alias("n_notices"), "notices", "copies")
    return out.select(*out.columns[:-1], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def oracle() -> str:
    """DuckDB SQL for scan() of documents with the licences known here."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), {quote(COPYRIGHT_LINE)}, '\\1', 'g'), {quote(BETWEEN)}, ' ', 'g')"
    form = f"' ' || replace({form}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in SPELLINGS.items():
        form = f"replace({form}, ' {old} ', ' {new} ')"
    lines = f"list_filter(list_transform(string_split({form}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    digest = lambda x: f"sha256(regexp_replace({x}, ' +', ' ', 'g'))"
    rows = [*TEXTS.items(), *((k, n) for k, ns in NOTICES.items() for n in ns)]
    return f"""
WITH texts(license, text) AS (VALUES {", ".join(f"({quote(k)}, {quote(t)})" for k, t in rows)}),
known AS (SELECT d, min(license) AS license FROM (SELECT {digest("array_to_string(l, ' ')")} AS d, license FROM (SELECT license, {lines} AS l FROM texts) UNION ALL VALUES {", ".join(f"({quote(d)}, {quote(k)})" for k, d in DIGESTS.items())}) GROUP BY d),
docs AS (SELECT doc_id, l, {digest("array_to_string(l, ' ')")} AS digest FROM (SELECT doc_id, {lines} AS l FROM documents)),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, unnest(list_transform(l, lambda x: {digest("x")})) AS d FROM docs) JOIN known USING (d) GROUP BY doc_id)
SELECT docs.doc_id, digest, known.license AS text_license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON known.d = digest LEFT JOIN found ON found.doc_id = docs.doc_id"""
