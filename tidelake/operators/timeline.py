"""A source that plays in a loop until an experiment ends, cut at its own boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def looping_segments(df: DataFrame, by: Sequence[str], source: str, piece: str, total: str) -> DataFrame:
    """by, segment, loop, gop, start, end, content_start, content_end: [0, total) cut at the ends of pieces, of loops of the source, and of the whole.

    All lengths are whole numbers of one unit and above 0, else a row gives nothing. The
    last piece of a loop is shorter where the source is no multiple of it; the last
    segment ends with the experiment. Cuts come from two sequences, so a row makes only
    the segments it has.
    """
    good = df.where((F.col(source) > 0) & (F.col(piece) > 0) & (F.col(total) > 0)).select(*by, F.col(source).cast("long").alias("__s"), F.col(piece).cast("long").alias("__p"), F.col(total).cast("long").alias("__t"))
    loops = good.withColumn("loop", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__t - 1) DIV __s"))))
    # Within a loop, pieces begin before both its own end and the experiment's.
    length = F.least(F.col("__s"), F.col("__t") - F.col("loop") * F.col("__s"))
    pieces = loops.withColumn("__len", length).withColumn("gop", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__len - 1) DIV __p"))))
    start, stop = F.col("gop") * F.col("__p"), F.least((F.col("gop") + 1) * F.col("__p"), F.col("__len"))
    a_loop = F.expr("(__s - 1) DIV __p + 1")
    base = F.col("loop") * F.col("__s")
    return pieces.select(*by, (F.col("loop") * a_loop + F.col("gop")).alias("segment"), "loop", "gop", (base + start).alias("start"), (base + stop).alias("end"), start.alias("content_start"), stop.alias("content_end"))


def located(points: DataFrame, at: str, source: str, piece: str) -> DataFrame:
    """points with segment, loop, gop and content_time of a time from 0 on, worked out without a join; null before 0."""
    t = F.when(F.col(at) >= 0, F.col(at).cast("long"))
    out = points.withColumns({"__t": t, "__s": F.col(source).cast("long"), "__p": F.col(piece).cast("long")})
    out = out.withColumns({"loop": F.expr("__t DIV __s"), "content_time": F.expr("__t % __s")}).withColumn("gop", F.expr("content_time DIV __p"))
    return out.withColumn("segment", F.expr("loop * ((__s - 1) DIV __p + 1) + gop")).drop("__t", "__s", "__p")


def expanded(entries: DataFrame, by: Sequence[str], place: str | Sequence[str], start: str, length: str, repeat: str, end: str) -> DataFrame:
    """by, number (from 0), start, length, fault of run-length entries: an entry is repeat + 1 pieces of `length` that follow each other.

    An entry without a start goes on from the one before, the first from 0. A repeat of -1
    goes on up to the next entry's start, or to `end`. fault, on the first piece of an
    entry: "length" where it is not above 0, "repeat" where it is below -1, or -1 without
    a known end (such an entry gives that one row, with no length); "overlap" or "gap"
    where a start is not where the pieces before ended.

    Entries are sorted once, by `by` and place. Give as place the columns by which an
    earlier window numbered them, rather than the number, and its sort serves here too.
    """
    places = [place] if isinstance(place, str) else list(place)
    w = Window.partitionBy(*by).orderBy(*places)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    t, d, r = F.col(start).cast("long"), F.col(length).cast("long"), F.coalesce(F.col(repeat).cast("long"), F.lit(0))
    rows = entries.select(*by, *[c for c in places if c not in by], t.alias("__t"), d.alias("__d"), r.alias("__r"), F.coalesce(F.lead(t).over(w), F.when(F.lead(d).over(w).isNull(), F.col(end).cast("long"))).alias("__until"))
    bad = F.when(F.coalesce(F.col("__d"), F.lit(0)) <= 0, "length").when((F.col("__r") < -1) | (F.col("__r") == -1) & F.col("__until").isNull(), "repeat")
    rows = rows.withColumn("__bad", bad)
    span = F.when(F.col("__bad").isNotNull() | (F.col("__r") == -1), 0).otherwise(F.col("__d") * (F.col("__r") + 1))
    rows = rows.withColumn("__span", span)
    # Spans since the last given start are all so far less those before it; summed by halves of 32 bits, as only the difference is known to fit a long.
    halves = {"__high": F.shiftright("__span", 32), "__low": F.col("__span").bitwiseAND(F.lit(0xFFFFFFFF))}
    sums = {n: F.coalesce(F.sum(half).over(before), F.lit(0)) for n, half in halves.items()}
    rows = rows.withColumns({"__base": F.coalesce(F.last("__t", True).over(so_far), F.lit(0)), **sums})
    since = {n: F.col(n) - F.coalesce(F.last(F.when(F.col("__t").isNotNull(), F.col(n)), True).over(so_far), F.lit(0)) for n in halves}
    rows = rows.withColumns(since).withColumn("__s", F.col("__base") + (F.col("__high") * F.lit(1 << 32) + F.col("__low")))
    count = F.when(F.col("__bad").isNotNull(), 1).when(F.col("__r") == -1, F.greatest(F.ceil((F.col("__until") - F.col("__s")) / F.col("__d")), F.lit(0))).otherwise(F.col("__r") + 1)
    rows = rows.withColumn("__n", count.cast("long"))
    stop = F.when(F.col("__bad").isNotNull(), F.col("__s")).when(F.col("__r") == -1, F.greatest(F.col("__until"), F.col("__s"))).otherwise(F.col("__s") + F.col("__span"))
    rows = rows.withColumns({"__stop": stop, "__first": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    last = F.lag("__stop").over(w)
    rows = rows.withColumn("__fault", F.coalesce(F.col("__bad"), F.when(F.col("__t") < last, "overlap").when(F.col("__t") > last, "gap")))
    out = rows.where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    begin = F.col("__s") + F.col("__k") * F.col("__d")
    whole = F.when(F.col("__bad").isNotNull(), None).when((F.col("__r") == -1), F.least(F.col("__d"), F.col("__until") - begin)).otherwise(F.col("__d"))
    return out.select(*by, (F.col("__first") + F.col("__k")).alias("number"), F.when(F.col("__bad").isNull(), begin).otherwise(F.col("__s")).alias("start"), whole.alias("length"), F.when(F.col("__k") == 0, F.col("__fault")).alias("fault"))


def timeline_faults(pieces: DataFrame, index: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, number, fault): pieces that carry a fault, and where pieces and a side-car index (by, number, start, length) differ: not indexed, not in the timeline, start or length."""
    own = pieces.where("fault IS NOT NULL").select(*by, "number", "fault")
    a = pieces.select(*by, "number", F.col("start").alias("__s"), F.col("length").alias("__l"), F.lit(True).alias("__a"))
    b = index.select(*by, "number", F.col("start").cast("long").alias("__is"), F.col("length").cast("long").alias("__il"), F.lit(True).alias("__b"))
    both = a.join(b, [*by, "number"], "full")
    fault = F.when(F.col("__b").isNull(), "not indexed").when(F.col("__a").isNull(), "not in the timeline").when(~F.col("__s").eqNullSafe(F.col("__is")), "start").when(~F.col("__l").eqNullSafe(F.col("__il")), "length differs")
    return own.unionByName(both.withColumn("fault", fault).where("fault IS NOT NULL").select(*by, "number", "fault"))
