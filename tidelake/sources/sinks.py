"""Writers: canonical JSON lines, flat CSV, exported decisions, and outputs with a checked marker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.metrics import fingerprint

MARKER = "_complete"


def canonical_json(df: DataFrame, path: str) -> None:
    """JSON lines with columns in order of name; numbers that JSON has no form for are an error."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    checked = df.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)) for c in floats})
    checked.select(*sorted(df.columns)).write.json(path, ignoreNullFields=False)


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nested columns as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True)


def flat_csv_of_all(frames: Sequence[DataFrame], path: str) -> None:
    """One CSV of tables of different shapes: its columns are theirs together in order of name, empty where a table lacks one."""
    if not frames:
        raise ValueError("no tables")
    nested = lambda df: [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    plain = [df.select(*[(F.to_json(c) if c in nested(df) else F.col(c).cast("string")).alias(c) for c in df.columns]) for df in frames]
    both = plain[0]
    for df in plain[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    both.select(*sorted(both.columns)).write.csv(path, header=True)


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A summary as a Markdown table: numbers to so many digits, nulls as NA; tables of more rows than `most` are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "NA" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(x) for x in r] for r in rows]]
    return "".join("| " + " | ".join(r) + " |\n" for r in lines)


def export_decisions(decisions: DataFrame, path: str) -> None:
    """Flat tables of nested decisions, joined by decision_id: decisions; selections (instance_id, quality) from the map `selection`; and, where the columns are there, candidates from `candidates` (an array of structs of instance_id, quality, utility, cost; each with whether it was selected) and visibility from `visibility` (a map of instance_id to a number).

    The four are written one after the other, each anew; a null map or array gives no rows.
    """
    nested = [c for c in ("selection", "candidates", "visibility") if c in decisions.columns]
    chosen = decisions.select("decision_id", F.explode("selection").alias("instance_id", "quality"))
    tables = {"decisions": decisions.drop(*nested), "selections": chosen}
    if "candidates" in nested:
        each = decisions.select("decision_id", F.posexplode("candidates").alias("place", "c")).select("decision_id", "place", "c.*")
        marked = each.join(chosen.withColumn("selected", F.lit(True)), ["decision_id", "instance_id", "quality"], "left")
        tables["candidates"] = marked.withColumn("selected", F.coalesce("selected", F.lit(False)))
    if "visibility" in nested:
        tables["visibility"] = decisions.select("decision_id", F.explode("visibility").alias("instance_id", "visible"))
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def commit(df: DataFrame, path: str, configuration: str) -> str:
    """Writes a table, then its marker with the rows' fingerprint; the marker comes last, so a broken run has none."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    digest = _fingerprint(written, written.columns)
    row = [(configuration, digest, written.count())]
    df.sparkSession.createDataFrame(row, "configuration string, fingerprint string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/{MARKER}")
    return digest


def is_complete(spark: SparkSession, path: str, configuration: str) -> bool:
    """Whether a marker is there for this configuration and the rows still have its fingerprint."""
    try:
        marker = spark.read.schema("configuration string, fingerprint string, n long").json(f"{path}/{MARKER}").first()
        data = spark.read.parquet(f"{path}/data")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return marker is not None and marker["configuration"] == configuration and marker["fingerprint"] == _fingerprint(data, data.columns)


def run_stage(spark: SparkSession, path: str, configuration: str, build) -> DataFrame:
    """The stage's table: read where it is complete for this configuration, else built by build() and committed."""
    if not is_complete(spark, path, configuration):
        commit(build(), path, configuration)
    return spark.read.parquet(f"{path}/data")


def _fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    row = fingerprint(df, columns).first()
    return row["fingerprint"] if row else ""


def manifest_xml(rates: DataFrame, path: str, content: str, rank: str, duration_s: float) -> None:
    """A manifest in XML of representation_rates(): one Representation an element, in order of content and rank, with its rates as attributes; equal rates give equal bytes.

    Rates beyond 32 bits are cut there and written in full as requiredBandwidth as well.
    """
    most = 2**32 - 1
    attributes = [F.concat_ws("-", content, rank).alias("_id"), F.col(content).alias("_content"), F.col(rank).alias("_rank"), F.least(F.col("required_bps"), F.lit(most)).alias("_bandwidth"), F.when(F.col("required_bps") > most, F.col("required_bps")).alias("_requiredBandwidth"), F.col("mean_bps").alias("_meanBandwidth"), F.col("segments").alias("_segments")]
    rows = rates.orderBy(content, rank).select(*attributes).coalesce(1)  # a manifest is one small document
    rows.write.format("xml").option("rootTag", f'MPD type="static" mediaPresentationDuration="PT{duration_s:g}S"').option("rowTag", "Representation").option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def event_log(events: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """A stream's events as JSON lines, each once across restarts; a running query, which with available_now ends at the events that are there."""
    writer = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
