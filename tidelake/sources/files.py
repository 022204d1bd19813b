"""Scans of the file formats that traces, events, profiles and run results come in.

Each takes paths that Spark reads, checks what it read with a query, and gives a
DataFrame; a failed check raises with the number of bad rows and the first of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelake.functions.strict import strict_json
from tidelake.operators.graphs import decode_layers
from tidelake.operators.relational import closure
from tidelake.sources import segments

TIME_NAMES = ("time_s", "time_seconds", "timestamp", "time", "at_s", "t")
RATE_NAMES = ("mbps", "bandwidth_mbps", "rate_mbps")
BITS_NAMES = ("bps", "bandwidth_bps", "rate_bps")
END_POLICIES = ("hold", "stop", "error")


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, or an error if any row is bad."""
    found = df.where(bad).limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")
    return df


def first_of(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def _trace_columns(raw: DataFrame) -> DataFrame:
    time, rate, bits = (first_of(raw.columns, n) for n in (TIME_NAMES, RATE_NAMES, BITS_NAMES))
    if time is None or rate is None and bits is None:
        raise ValueError(f"no time or rate among {raw.columns}")
    mbps = F.col(rate).cast("double") if rate else F.col(bits).cast("double") / 1e6
    return raw.select(F.col(time).cast("double").alias("time_s"), mbps.alias("mbps"))


def _checked_trace(points: DataFrame) -> DataFrame:
    points = require(points, F.col("time_s").isNull() | F.col("mbps").isNull() | F.isnan("mbps") | (F.col("mbps") < 0) | (F.col("time_s") < 0), "trace points that are missing, negative or no numbers")
    repeated = points.groupBy("time_s").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"trace time {repeated[0]['time_s']} repeats")
    return points


def bandwidth_trace(spark: SparkSession, path: str, end_policy: str = "stop", duration_s: float | None = None, loop: bool = False) -> DataFrame:
    """(time_s, mbps, end_s, end_policy) of a trace in CSV, or JSON of {points, duration_s, loop, end_policy} or a bare list.

    A row holds until the next; the last until the horizon. A trace starts at zero. A
    horizon is required unless the policy is hold, and lies past the last point; rates in
    bits a second become megabits.
    """
    if end_policy not in END_POLICIES:
        raise ValueError(f"end policy {end_policy}")
    if path.endswith(".csv"):
        points = _trace_columns(spark.read.csv(path, header=True))
    elif path.endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
        if "points" in raw.columns:
            head = raw.select(*[F.col(c) for c in ("duration_s", "loop", "end_policy") if c in raw.columns]).first().asDict()
            duration_s, loop, end_policy = head.get("duration_s") or duration_s, bool(head.get("loop", loop)), head.get("end_policy") or end_policy
            raw = raw.select(F.explode("points").alias("p")).select("p.*")
        points = _trace_columns(raw)
    else:
        raise ValueError(f"trace files are .csv or .json, not {path}")
    points = _checked_trace(points)
    if end_policy != "hold" and not loop and duration_s is None:
        raise ValueError("a horizon is required unless the end policy is hold")
    first, last = points.agg(F.min("time_s"), F.max("time_s")).first()
    if first != 0:
        raise ValueError(f"a trace starts at zero, not at {first}")
    if duration_s is not None and duration_s <= last:
        raise ValueError(f"the horizon {duration_s} is not past the last point {last}")
    nxt = F.lead("time_s").over(Window.orderBy("time_s"))  # one trace: thousands of points
    end = F.coalesce(nxt, F.lit(duration_s).cast("double"), F.lit(float("inf")))
    return points.withColumn("end_s", end).withColumn("end_policy", F.lit("loop" if loop else end_policy))


def constant_trace(spark: SparkSession, mbps: float, duration_s: float | None = None) -> DataFrame:
    """The trace of one rate, where there is only a number: it holds to the horizon, or for good."""
    if not 0 <= mbps < float("inf") or duration_s is not None and not duration_s > 0:
        raise ValueError(f"a rate of {mbps} for {duration_s} seconds")
    end = float("inf") if duration_s is None else float(duration_s)
    return spark.createDataFrame([(0.0, float(mbps), end, "hold" if duration_s is None else "stop")], "time_s double, mbps double, end_s double, end_policy string")


def telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of JSON lines under a schema; a line that does not parse is an error, not a null."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def visibility_series(spark: SparkSession, path: str) -> DataFrame:
    """(time_s, instance_id, weight) from CSV in long form or with one column an instance, or from JSON: rows of the long form, or of time_s and a map `weights`; repeated keys are refused."""
    if path.endswith((".json", ".jsonl")):
        schema = "time_s double, instance_id string, weight double, weights map<string,double>"
        rows = spark.read.schema(schema).json(path, multiLine=path.endswith(".json"), mode="FAILFAST")
        raw = rows.select("time_s", F.explode(F.coalesce("weights", F.create_map("instance_id", "weight"))).alias("instance_id", "weight"))
    else:
        raw = spark.read.csv(path, header=True)
    if {"time_s", "instance_id", "weight"} <= set(raw.columns):
        long = raw.select(F.col("time_s").cast("double").alias("time_s"), "instance_id", F.col("weight").cast("double").alias("weight"))
    else:
        ids = [c for c in raw.columns if c != "time_s"]
        long = raw.unpivot("time_s", ids, "instance_id", "weight").select(F.col("time_s").cast("double").alias("time_s"), "instance_id", F.col("weight").cast("double").alias("weight"))
    require(long.groupBy("time_s", "instance_id").count(), F.col("count") > 1, "keys that repeat")
    return require(long, F.col("weight").isNull() | (F.col("weight") < 0), "weights that are missing or negative")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, gop_id, quality_rank, quality_id, sse, resource_ids of a nested profile document."""
    doc = spark.read.json(path, multiLine=True)
    rows = doc.select(F.explode("instances").alias("i")).select("i.instance_id", F.explode("i.gops").alias("g")).select("instance_id", "g.gop_id", F.posexplode("g.qualities").alias("quality_rank", "q"))
    flat = rows.select("instance_id", "gop_id", "quality_rank", "q.quality_id", F.col("q.sse").cast("double").alias("sse"), "q.resource_ids")
    require(flat.groupBy("instance_id", "gop_id", "quality_id").count(), F.col("count") > 1, "qualities that repeat")
    return require(flat, F.col("sse").isNull() | (F.col("sse") < 0), "errors that are missing or negative")


def profile_resources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resource_id, bytes, depends_on) of a nested profile document's resource table, and (instance_id, gop_id, quality_id, resource_id, depth): what each quality needs with all that this depends on.

    A resource that repeats, has no bytes, is named by a quality or another resource and is
    not in the table, or depends on itself, is refused.
    """
    schema = "resources array<struct<resource_id: string, bytes: long, depends_on: array<string>>>"
    table = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.explode("resources").alias("r")).select("r.*").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    require(table.groupBy("resource_id").count(), F.col("count") > 1, "resources that repeat")
    require(table, F.col("resource_id").isNull() | F.col("bytes").isNull() | (F.col("bytes") < 0), "resources without bytes")
    edges = table.select("resource_id", F.explode("depends_on").alias("parent"))
    require(decode_layers(table, edges, "resource_id", "resource_id", "parent"), F.col("fault").isNotNull(), "resources that cannot be had")
    named = profiles(spark, path).select("instance_id", "gop_id", "quality_id", F.explode("resource_ids").alias("resource_id"))
    require(named.join(table, "resource_id", "left_anti"), F.lit(True), "qualities that name an unknown resource")
    far = closure(edges, "parent", "resource_id").select(F.col("node").alias("resource_id"), "ancestor", "depth")
    needs = named.join(far, "resource_id").select("instance_id", "gop_id", "quality_id", F.col("ancestor").alias("resource_id"), "depth")
    every = named.withColumn("depth", F.lit(0)).unionByName(needs).groupBy("instance_id", "gop_id", "quality_id", "resource_id").agg(F.min("depth").alias("depth"))
    return table, every


def run_artifacts(spark: SparkSession, root: str, parts: Sequence[str] = ("scenario", "objects", "duration", "method")) -> DataFrame:
    """Completion markers <root>/<part>/.../completion.json with the path's parts as columns."""
    pattern = "/".join(["*"] * len(parts))
    raw = spark.read.json(f"{root}/{pattern}/completion.json", multiLine=True).withColumn("__p", F.split(F.col("_metadata.file_path"), "/"))
    names = {p: F.element_at("__p", -1 - len(parts) + k) for k, p in enumerate(parts)}
    return raw.withColumns(names).drop("__p")


def manifest_xml(spark: SparkSession, path: str, row_tag: str = "Representation") -> DataFrame:
    """Elements of XML manifests; documents with a DTD or entities are refused."""
    text = spark.read.text(path, wholetext=True)
    require(text.select(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)").alias("unsafe")), F.col("unsafe"), "manifests with a DTD or entities")
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def strict_documents(spark: SparkSession, path: str, schema: str, max_bytes: int = 16 << 20) -> DataFrame:
    """(path, document) of JSON files that hold one document each, under a schema.

    Files longer than max_bytes are refused before they are read; so are texts that are no
    JSON, have a name twice, NaN or an infinity, or anything after their end, and
    documents that the schema does not fit.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    require(sizes, F.col("length") > max_bytes, "documents that are too long")
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    require(texts.select("path", strict_json(F.col("value"), max_bytes)["fault"].alias("fault")), F.col("fault").isNotNull(), "documents that are not strict JSON")
    fitted = texts.select("path", *_fitted(schema))
    require(fitted.select("path", "unfit"), F.col("unfit"), "documents that the schema does not fit")
    return fitted.select("path", "document")


def _fitted(schema: str) -> tuple[Column, Column]:
    """document: value under a schema; unfit: whether it has another form."""
    names = [f.name for f in StructType.fromDDL(schema).fields]
    read = F.from_json("value", f"{schema}, __unfit string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__unfit"})
    return F.struct(*[read[n].alias(n) for n in names]).alias("document"), (read.isNull() | read["__unfit"].isNotNull()).alias("unfit")


def strict_lines(spark: SparkSession, path: str, schema: str, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents of JSON lines under a schema, and (path, text, fault) of the lines that are refused; blank lines do not count."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), "value", strict_json(F.col("value"), max_bytes)["fault"].alias("fault"))
    read = lines.select("path", "value", *_fitted(schema), "fault").withColumn("fault", F.coalesce("fault", F.when(F.col("unfit"), "schema")))
    bad = read.where("fault IS NOT NULL").select("path", F.substring("value", 1, 200).alias("text"), "fault")
    return read.where("fault IS NULL").select("document.*"), bad


MPD_NAMESPACE = "urn:mpeg:dash:schema:mpd:2011"


def manifest_timelines(spark: SparkSession, path: str, profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, representation, place, t, d, r, end) of the segment timelines of MPD manifests, and (path, representation, bandwidth, timescale).

    A manifest must be in the MPD namespace and, if asked, name a profile. end is the
    presentation's length in the timeline's units, null where the manifest has none; only
    lengths of whole and decimal seconds, minutes and hours are read (PT1H2M3.5S).
    """
    manifest_xml(spark, path, "MPD")  # refuses a DTD
    schema = "_xmlns string, _profiles string, _mediaPresentationDuration string, Period array<struct<AdaptationSet: array<struct<Representation: array<struct<_id: string, _bandwidth: long, SegmentTemplate: struct<_timescale: long, SegmentTimeline: struct<S: array<struct<_t: long, _d: long, _r: long>>>>>>>>>>"
    doc = spark.read.format("xml").option("rowTag", "MPD").schema(schema).load(path).withColumn("path", F.col("_metadata.file_path"))
    require(doc, ~F.col("_xmlns").eqNullSafe(F.lit(MPD_NAMESPACE)), "manifests of another namespace")
    if profile:
        require(doc, ~F.coalesce(F.array_contains(F.split("_profiles", r"\s*,\s*"), profile), F.lit(False)), f"manifests without the profile {profile}")
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract("_mediaPresentationDuration", rf"([0-9.]+){unit}", 1), F.lit("")).cast("decimal(20,6)"), F.lit(0))
    seconds = F.when(F.col("_mediaPresentationDuration").rlike(r"^PT([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))
    reps = doc.withColumn("seconds", seconds).select("path", "seconds", F.explode("Period").alias("p")).select("path", "seconds", F.explode("p.AdaptationSet").alias("a")).select("path", "seconds", F.explode("a.Representation").alias("r"))
    reps = reps.select("path", "seconds", F.col("r._id").alias("representation"), F.col("r._bandwidth").alias("bandwidth"), F.coalesce("r.SegmentTemplate._timescale", F.lit(1)).cast("long").alias("timescale"), F.col("r.SegmentTemplate.SegmentTimeline.S").alias("s"))
    require(reps, F.col("representation").isNull() | F.col("s").isNull(), "representations without an id or a timeline")
    require(reps.groupBy("path", "representation").count(), F.col("count") > 1, "representations that repeat")
    entries = reps.select("path", "representation", F.floor(F.col("seconds") * F.col("timescale")).cast("long").alias("end"), F.posexplode("s").alias("place", "x"))
    return entries.select("path", "representation", "place", F.col("x._t").alias("t"), F.col("x._d").alias("d"), F.col("x._r").alias("r"), "end"), reps.select("path", "representation", "bandwidth", "timescale")


def container_header(spark: SparkSession, path: str, magic: bytes, schema: str) -> DataFrame:
    """path and header struct of binary containers, a file or those below a folder: magic, header length (8 bytes, little endian), JSON header. Only headers are read."""
    segments.register(spark)
    raw = require(spark.read.format("tidelake_header").option("magic", magic.hex()).load(path), F.col("fault").isNotNull(), "containers with a wrong magic or header")
    return raw.select("path", F.from_json(F.col("header").cast("string"), schema, {"mode": "FAILFAST"}).alias("header"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """task, stage, status, started, finished of JSON journals {tasks: {name: {stages: {name: {status, started_at, finished_at}}}}}; times are ISO texts with a zone, a status is required."""
    schema = "tasks map<string, struct<stages: map<string, struct<status: string, started_at: string, finished_at: string>>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    tasks = doc.select(F.explode("tasks").alias("task", "t")).select("task", F.explode("t.stages").alias("stage", "s"))
    time = lambda c: F.col(c).cast("timestamp")
    rows = tasks.select("task", "stage", "s.status", time("s.started_at").alias("started"), time("s.finished_at").alias("finished"))
    require(rows.groupBy("task", "stage").count(), F.col("count") > 1, "stages that repeat")
    return require(rows, F.col("status").isNull() | (F.col("finished") < F.col("started")), "stages without a status, or that end before they start")


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of a CSV file as sinks write them, under a schema: nested columns are JSON texts there. Empty and "NA" cells are null; a column that is missing, or a cell that does not fit, is refused; further columns are left out."""
    fields = StructType.fromDDL(schema).fields
    raw = spark.read.csv(path, header=True, multiLine=True)
    if lacks := [f.name for f in fields if f.name not in raw.columns]:
        raise ValueError(f"{path} has no column {lacks[0]}")
    nested = lambda f: f.dataType.typeName() in ("struct", "array", "map")
    cell = lambda f: F.when(~F.col(f.name).isin("", "NA"), F.col(f.name))
    read = {f.name: F.from_json(cell(f), f.dataType) if nested(f) else cell(f).try_cast(f.dataType) for f in fields}
    both = raw.select(*[cell(f).alias(f"__{f.name}") for f in fields], *[c.alias(n) for n, c in read.items()])
    unfit = F.lit(False)
    for f in fields:
        unfit |= F.col(f"__{f.name}").isNotNull() & F.col(f.name).isNull()
    return require(both, unfit, "cells that do not fit the schema").select(*read)


def context_key(columns: Sequence[str]) -> Column:
    """SHA-256 of a context as canonical JSON: fields in order of name, nulls written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def cached_values(spark: SparkSession, path: str, context: str, value: str = "value double") -> DataFrame:
    """Cached measurements of JSON lines with the key of their context; a context that two lines measure differently is refused, equal lines count once.

    context and value are schemas; every field of the context is required.
    """
    known = spark.read.schema(f"{context}, {value}").json(path, mode="FAILFAST")
    names = [c for c in known.columns if c not in {v.strip().split(" ")[0] for v in value.split(",")}]
    lacks = F.lit(False)
    for c in names:
        lacks |= F.col(c).isNull()
    keyed = require(known, lacks, "contexts that lack a field").withColumn("key", context_key(names)).distinct()
    require(keyed.groupBy("key").count(), F.col("count") > 1, "contexts measured twice with different results")
    return keyed


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(digest, name) of a list of SHA-256 digests and names, as sha256sum writes it; lines that are no such pair and names that repeat are refused."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 1).alias("digest"), F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("name"), "value")
    rows = require(parts, F.col("digest") == "", "lines that are no digest and name").drop("value")
    require(rows.groupBy("name").count(), F.col("count") > 1, "names that repeat")
    return rows


def hash_list_faults(spark: SparkSession, list_path: str, root: str) -> DataFrame:
    """(name, fault) of the files below root against a hash list: changed, missing, or unlisted (the list itself is not). Files are hashed whole, each in a task, up to 2 GB."""
    base = _file_path(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    there = files.select(F.substring(_plain(F.col("path")), len(base) + 2, 4096).alias("name"), F.sha2("content", 256).alias("found"))
    itself = _file_path(spark, list_path)[len(base) + 1 :]
    both = hash_list(spark, list_path).join(there.where(F.col("name") != itself), "name", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.col("digest") != F.col("found"), "changed")
    return both.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def _plain(path: Column) -> Column:
    """A file's path without its scheme and host."""
    return F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?", "")


def _file_path(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath()


def full_coverage(spark: SparkSession, quality_path: str, profile_path: str, key: str, values: str) -> DataFrame:
    """Rows of measured quality (JSON lines) bound to their profiles (JSON lines of the key and profile_id); a key that one side lacks or has twice is refused.

    key and values are schemas, such as "scene string, quality int" and "psnr double, mse double"; a missing or negative value is refused.
    """
    names, measures = ([v.strip().split(" ")[0] for v in s.split(",")] for s in (key, values))
    quality = spark.read.schema(f"{key}, {values}").json(quality_path, mode="FAILFAST")
    bound = spark.read.schema(f"{key}, profile_id string").json(profile_path, mode="FAILFAST")
    for df in (quality, bound):
        require(df.groupBy(*names).count(), F.col("count") > 1, "keys that repeat")
    both = quality.withColumn("__q", F.lit(True)).join(bound.withColumn("__b", F.lit(True)), names, "full")
    require(both, F.col("__q").isNull() | F.col("__b").isNull(), "keys that one side lacks")
    bad = F.lit(False)
    for m in measures:
        bad |= F.col(m).isNull() | F.isnan(m) | (F.col(m) < 0)
    return require(both.drop("__q", "__b"), bad, "values that are missing or negative")


PREPARED = "object struct<id: string>, representations array<struct<id: string, quality: int, segments: array<string>>>, package struct<segments: array<struct<id: string, path: string, bytes: long>>>"


def prepared_content(spark: SparkSession, root: str, validate_files: bool = True) -> DataFrame:
    """object_id, representation_id, quality, place, segment_id, path, bytes of the manifests root/*/manifest.json.

    A segment that no package index has, or that it has twice, is refused; so is a file
    that is missing or of another size, unless only the metadata is asked for.
    """
    doc = spark.read.schema(PREPARED).json(f"{root}/*/manifest.json", multiLine=True, mode="FAILFAST").withColumn("directory", F.regexp_extract(_plain(F.col("_metadata.file_path")), r"^(.*)/manifest\.json$", 1))
    require(doc, F.col("object.id").isNull() | F.col("representations").isNull() | F.col("package.segments").isNull(), "manifests that lack a part")
    index = doc.select("directory", F.explode("package.segments").alias("s")).select("directory", F.col("s.id").alias("segment_id"), "s.path", "s.bytes")
    require(index.groupBy("directory", "segment_id").count(), F.col("count") > 1, "segments indexed twice")
    wanted = doc.select("directory", F.col("object.id").alias("object_id"), F.explode("representations").alias("r")).select("directory", "object_id", F.col("r.id").alias("representation_id"), "r.quality", F.posexplode("r.segments").alias("place", "segment_id"))
    rows = require(wanted.join(index, ["directory", "segment_id"], "left"), F.col("path").isNull() | F.col("bytes").isNull(), "segments without an index entry")
    if validate_files:
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_plain(F.col("path")).alias("__file"), F.col("length").alias("__length"))
        named = rows.withColumn("__file", F.concat_ws("/", "directory", "path")).join(sizes, "__file", "left")
        require(named, F.col("__length").isNull() | (F.col("__length") != F.col("bytes")), "segment files that are missing or of another size")
    return rows.select("object_id", "representation_id", "quality", "place", "segment_id", F.concat_ws("/", "directory", "path").alias("path"), "bytes")


BUNDLE = "objects array<struct<object_id: string, profile: string, manifest: string>>"


def quality_bundle(spark: SparkSession, root: str, values: str = "psnr double, mse double") -> DataFrame:
    """object_id, quality_id and values of a bundle: SHA256SUMS, index.json, and the profile and the manifest of each object that the index names.

    Every listed file must have its digest, every profile and manifest must be listed, a
    profile must be its object's and name the digest of its manifest, and an object's
    qualities must not repeat.
    """
    require(hash_list_faults(spark, f"{root}/SHA256SUMS", root), F.lit(True), "files that are not as listed")
    index = spark.read.schema(BUNDLE).json(f"{root}/index.json", multiLine=True, mode="FAILFAST").select(F.explode("objects").alias("o")).select("o.*")
    require(index.groupBy("object_id").count(), F.col("count") > 1, "objects that repeat")
    listed = hash_list(spark, f"{root}/SHA256SUMS")
    digests = index.join(listed.select(F.col("name").alias("manifest"), F.col("digest").alias("__manifest")), "manifest", "left").join(listed.select(F.col("name").alias("profile"), F.lit(True).alias("__listed")), "profile", "left")
    require(digests, F.col("__manifest").isNull() | F.col("__listed").isNull(), "profiles or manifests that are not listed")
    kinds = ", ".join(f"{v.strip().split(' ')[0]}: {v.strip().split(' ')[1]}" for v in values.split(","))
    doc = spark.read.schema(f"object_id string, manifest_sha256 string, rows array<struct<quality_id: string, {kinds}>>").json(f"{root}/profiles", multiLine=True, mode="FAILFAST", recursiveFileLookup=True)
    name = F.substring(_plain(F.col("_metadata.file_path")), len(_file_path(spark, root)) + 2, 4096)
    profiles_ = doc.select(name.alias("profile"), F.col("object_id").alias("__owner"), "manifest_sha256", "rows")
    both = require(digests.join(profiles_, "profile", "left"), ~F.coalesce((F.col("__owner") == F.col("object_id")) & (F.col("manifest_sha256") == F.col("__manifest")), F.lit(False)), "profiles of another object or manifest")
    rows = both.select("object_id", F.explode("rows").alias("r")).select("object_id", "r.*")
    require(rows.groupBy("object_id", "quality_id").count(), F.col("count") > 1, "qualities that repeat")
    return rows
