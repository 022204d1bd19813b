"""What the index of a package breaks: frames, payloads, their needs, and the segments that hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.graphs import CYCLE, decode_layers
from tidelake.operators.storage import Scratch, ensure_checkpoint_dir

RULES = (
    "frame repeats", "frame order", "payload repeats", "unknown frame", "sample missing", "wrong epoch", "timestamp differs", "no refresh",
    "missing dependency", "dependency of another frame", "dependency cycle",
    "segment repeats", "unknown segment", "packaged twice", "unpackaged payload", "unknown member", "member differs", "offset gap", "offset overlap", "segment length", "segment crosses", "frame range",
)


#: What a row of the joint table is, and the columns that each kind has.
FRAME, PAYLOAD, NEED, SEGMENT, MEMBER = range(5)
COLUMNS = {
    FRAME: "place frame moment", PAYLOAD: "id mode quality frame epoch moment bytes digest refresh", NEED: "id parent",
    SEGMENT: "segment mode quality epoch header bytes first_frame last_frame", MEMBER: "segment place id offset length digest",
}


def package_index_faults(frames: DataFrame, payloads: DataFrame, needs: DataFrame, segments: DataFrame, members: DataFrame, epoch_frames: int, buckets: int | None = None) -> DataFrame:
    """(package, rule, key), one row a broken rule and key.

    frames: package, place, frame, moment. payloads: package, id, mode, quality, frame, epoch,
    moment, bytes, digest, refresh. needs: package, id, parent. segments: package, segment,
    mode, quality, epoch, header, bytes, first_frame, last_frame. members: package,
    segment, place, id, offset, length, digest.

    An epoch is `epoch_frames` frames by place. Every mode and quality that a package has
    must have every frame; each frame is reached from a refresh of its mode and quality at
    or before it in its epoch. Members follow each other from the header's end without gap
    or overlap up to the segment's length.

    The tables are stored as one, dealt by package into `buckets` (the session's shuffle
    partitions), and no rule shuffles after that. Rules are windows by package and what they
    are about instead of joins, so no package is gathered.
    """
    spark = frames.sparkSession
    ensure_checkpoint_dir(spark)
    tables = zip(COLUMNS, (frames, payloads, needs, segments, members))
    joint = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("package", F.lit(kind).alias("kind"), *COLUMNS[kind].split()) for kind, df in tables])
    scratch = Scratch(spark)
    rows = scratch.deal(joint, "package", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch.keep()
    needed = _needed(rows)
    told = [
        _told(_timed(rows, epoch_frames), {
            "frame repeats": (_is(FRAME) & (F.col("__n") > 1), ["frame"]),
            "frame order": (_is(FRAME) & F.expr("frame <= __f OR moment <= __t"), ["frame"]),
            "unknown frame": (_is(PAYLOAD) & F.col("position").isNull(), ["id"]),
            "wrong epoch": (_is(PAYLOAD) & F.col("position").isNotNull() & _differ(F.col("epoch"), F.col("__epoch")), ["id"]),
            "timestamp differs": (_is(PAYLOAD) & F.col("position").isNotNull() & _differ(F.col("moment").cast("double"), F.col("media_at").cast("double")), ["id"]),
            "no refresh": (_is(PAYLOAD) & F.col("position").isNotNull() & (F.coalesce("__r", F.lit(0)) == 0), ["id"]),
        }),
        _told(_lacking(rows), {"sample missing": (F.lit(True), ["mode", "quality", "frame"])}),
        _told(needed, {
            "missing dependency": (~F.col("there"), ["id"]),
            "dependency of another frame": (F.col("there") & F.col("elsewhere"), ["id", "parent"]),
        }),
        _told(_on_cycles(rows, needed), {"dependency cycle": (F.lit(True), ["id"])}),
        _told(_held(rows), {
            "payload repeats": (_is(PAYLOAD) & (F.col("__payloads") > 1), ["id"]),
            "unpackaged payload": (_is(PAYLOAD) & (F.col("__members") == 0), ["id"]),
            "packaged twice": (_is(MEMBER) & (F.col("__alike") > 1), ["id"]),
            "unknown member": (_is(MEMBER) & F.col("own").isNull(), ["segment", "id"]),
            "member differs": (_is(MEMBER) & F.col("own").isNotNull() & (_differ(F.col("length").cast("double"), F.col("own.bytes").cast("double")) | _differ(F.col("digest"), F.col("own.digest"))), ["segment", "id"]),
            "segment repeats": (_is(SEGMENT) & (F.col("__segments") > 1), ["segment"]),
            "unknown segment": (_is(MEMBER) & F.col("seg").isNull(), ["segment"]),
            "segment crosses": (_is(MEMBER) & F.col("own").isNotNull() & F.col("seg").isNotNull() & reduce(Column.__or__, [_differ(F.col(f"seg.{c}"), F.col(f"own.{c}")) for c in ("mode", "quality", "epoch")]), ["segment", "id"]),
            "offset gap": (_is(MEMBER) & F.col("seg").isNotNull() & (F.col("offset") > F.col("__due")), ["segment", "id"]),
            "offset overlap": (_is(MEMBER) & F.col("seg").isNotNull() & (F.col("offset") < F.col("__due")), ["segment", "id"]),
            "segment length": (_is(SEGMENT) & _differ(F.coalesce("__end", "seg.header"), F.col("seg.bytes")), ["segment"]),
            "frame range": (_is(SEGMENT) & (_differ(F.col("seg.first_frame"), F.col("__first")) | _differ(F.col("seg.last_frame"), F.col("__last"))), ["segment"]),
        }),
    ]
    return reduce(DataFrame.unionByName, told)


def _is(kind: int) -> Column:
    return F.col("kind") == kind


def _if(kind: int, value: Column | str) -> Column:
    return F.when(_is(kind), F.col(value) if isinstance(value, str) else value)


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _named(key: str) -> Column:
    """A null is like no other, in a package or as one."""
    return F.col("package").isNotNull() & F.col(key).isNotNull()


def _told(df: DataFrame, rules: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """(package, rule, key) of the rows that break a rule, each once; rules are a condition and what makes the key."""
    told = lambda rule, key: F.struct(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"))
    some = reduce(Column.__or__, [F.coalesce(when, F.lit(False)) for when, _ in rules.values()])
    broken = F.array(*[F.when(when, told(rule, key)) for rule, (when, key) in rules.items()])
    return df.where(some).select("package", F.explode(broken).alias("f")).where("f IS NOT NULL").select("package", "f.*").distinct()


def _timed(rows: DataFrame, epoch_frames: int) -> DataFrame:
    """Frames with the one before, payloads with their frame's position and moment, and whether a refresh of their kind came before."""
    by_place, at_frame = Window.partitionBy("package", "kind").orderBy("place", "frame"), Window.partitionBy("package", "frame")
    timed = rows.where(_is(FRAME) | _is(PAYLOAD)).withColumns({"__f": F.lag("frame").over(by_place), "__t": F.lag("moment").over(by_place), "__k": F.row_number().over(by_place) - 1})
    timed = timed.withColumns({"__n": F.count_if(_is(FRAME)).over(at_frame), "position": F.min(_if(FRAME, "__k")).over(at_frame), "media_at": F.min(_if(FRAME, "moment")).over(at_frame)})
    timed = timed.withColumn("position", F.when(_named("frame"), F.col("position"))).withColumn("__epoch", F.floor(F.col("position") / epoch_frames))
    by_kind = Window.partitionBy("package", "kind", "mode", "quality", "__epoch").orderBy("position").rangeBetween(Window.unboundedPreceding, 0)
    return timed.withColumn("__r", F.max(F.col("refresh").cast("int")).over(by_kind))


def _lacking(rows: DataFrame) -> DataFrame:
    """package, mode, quality and frame that have no payload. Of each frame the modes and qualities that it has are at hand as an array."""
    kind = F.struct("mode", "quality")
    kinds = rows.where(_is(PAYLOAD)).select("package", "mode", "quality").distinct()
    has = rows.where(_is(FRAME) | _is(PAYLOAD)).groupBy("package", "frame").agg(F.collect_set(_if(PAYLOAD, kind)).alias("__has"), F.count_if(_is(FRAME)).alias("__n")).where("__n > 0")
    return kinds.join(has, "package").where(F.expr("mode IS NULL OR quality IS NULL OR frame IS NULL") | ~F.array_contains("__has", kind))


def _needed(rows: DataFrame) -> DataFrame:
    """package, id and parent of the payloads' needs; there: the parent is a payload; elsewhere: of another frame."""
    of = Window.partitionBy("package", F.when(_is(PAYLOAD), F.col("id")).otherwise(F.col("parent")))
    found = lambda w: F.struct(F.count_if(_is(PAYLOAD)).over(w).alias("n"), F.count(_if(PAYLOAD, "frame")).over(w).alias("framed"), F.min(_if(PAYLOAD, "frame")).over(w).alias("lo"), F.max(_if(PAYLOAD, "frame")).over(w).alias("hi"))
    both = rows.where(_is(PAYLOAD) | _is(NEED)).withColumn("a", found(Window.partitionBy("package", "id"))).where(_is(PAYLOAD) | (_named("id") & (F.col("a.n") > 0)))
    both = both.withColumn("b", found(of)).where(_is(NEED))
    # Frames differ if there are two, or one and none.
    lone = (F.col("a.framed") + F.col("b.framed") > 0) & (F.col("a.framed") + F.col("b.framed") < F.col("a.n") + F.col("b.n"))
    two = F.coalesce(F.least("a.lo", "b.lo") < F.greatest("a.hi", "b.hi"), F.lit(False))
    return both.select("package", "id", "parent", (F.col("parent").isNotNull() & (F.col("b.n") > 0)).alias("there"), (lone | two).alias("elsewhere"))


def _on_cycles(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """package and id of payloads on a cycle of needs, or between two, that lack no own parent.

    A cycle goes up somewhere, from an id to a parent of at least that id; so does a path from
    one to another that passes below all such ids or above all such parents. So all of them
    lie between these two of their package, and only needs there are looked at.
    """
    bounds = rows.where(_is(NEED) & F.expr("parent >= id")).groupBy("package").agg(F.min("id").alias("__lo"), F.max("parent").alias("__hi"))
    node = lambda c: F.struct("package", F.col(c).alias("id"))
    with Scratch(rows.sparkSession) as scratch:
        near = scratch.store(needed.join(bounds, "package").where("id BETWEEN __lo AND __hi").select("package", "id", "parent", "there"))
        edges = near.where("there").select(node("id").alias("child"), node("parent").alias("parent"))
        nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
        on = decode_layers(nodes, edges, "node", "child", "parent").where(F.col("fault") == CYCLE).select("node.package", "node.id")
        return on.join(near.where("NOT there"), ["package", "id"], "left_anti").checkpoint()


def _held(rows: DataFrame) -> DataFrame:
    """Members with their payload (own), their segment (seg) and where they are due; segments with the end and frames of their members; payloads that are amiss."""
    at_id = Window.partitionBy("package", "id", _if(SEGMENT, "segment"))
    first = lambda kind, w, *c: F.first(_if(kind, F.struct(*c)), ignorenulls=True).over(w)
    held = rows.where(~_is(FRAME) & ~_is(NEED)).withColumns({
        "own": first(PAYLOAD, at_id, "frame", "mode", "quality", "epoch", "bytes", "digest"),
        "__payloads": F.count_if(_is(PAYLOAD)).over(at_id), "__alike": F.count_if(_is(MEMBER)).over(at_id),
    })
    held = held.withColumns({"own": F.when(_named("id"), F.col("own")), "__members": F.when(_named("id"), F.col("__alike")).otherwise(0)})
    held = held.where(~_is(PAYLOAD) | (F.col("__payloads") > 1) | (F.col("__members") == 0))
    at_segment, by_segment = Window.partitionBy("package", "segment", _if(PAYLOAD, "id")), Window.partitionBy("package", "segment", "kind").orderBy("place", "offset", "id")
    held = held.withColumn("__before", F.lag(F.col("offset") + F.col("length")).over(by_segment)).withColumns({
        "seg": first(SEGMENT, at_segment, "mode", "quality", "epoch", "header", "bytes", "first_frame", "last_frame"), "__segments": F.count_if(_is(SEGMENT)).over(at_segment),
        "__end": F.max(_if(MEMBER, F.col("offset") + F.col("length"))).over(at_segment), "__first": F.min(_if(MEMBER, "own.frame")).over(at_segment), "__last": F.max(_if(MEMBER, "own.frame")).over(at_segment),
    })
    held = held.withColumns({"seg": F.when(_is(SEGMENT) | _named("segment"), F.col("seg"))} | {c: F.when(_named("segment"), F.col(c)) for c in ("__end", "__first", "__last")})
    return held.withColumn("__due", F.coalesce("__before", "seg.header"))


def rule_counts(faults: DataFrame) -> DataFrame:
    """rule and n of every rule, those that nothing breaks with 0."""
    rules = faults.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    return rules.join(faults.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))

