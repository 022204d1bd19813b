"""Time series: as-of and range joins, hold weights, integrals, intervals, estimators.

Intervals are half-open, [start, end). Times are any orderable numbers unless a
function says otherwise; timestamps are turned to seconds by seconds().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.storage import bounded


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, for zoned and unzoned timestamps alike (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def _tagged(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    keys = list(on)
    names = [f"{prefix}{v}" for v in values]
    a = left.withColumn("__side", F.lit(1)).withColumn("__t", F.col(left_time))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.struct(F.col(right_time).alias("__rt"), *[F.col(v) for v in values]).alias("__r"), F.lit(0).alias("__side"))
    return a.unionByName(b, allowMissingColumns=True), names


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], prefix: str = "asof_", forward: bool = False, strict: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    forward: the earliest at or after instead. strict: equal times do not match. One
    shuffle by key and one sort serve both sides; nothing is multiplied. A left row
    without a match has nulls. Right rows of one key should have different times.
    """
    both, names = _tagged(left, right, on, left_time, right_time, values, prefix)
    # At equal times right rows come first, unless they must not match.
    time = F.col("__t").desc() if forward else F.col("__t").asc()
    order = [time, F.col("__side").desc() if strict else F.col("__side").asc()]
    frame = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__m", F.last("__r", ignorenulls=True).over(frame)).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__m.{v}").alias(n) for v, n in zip(values, names, strict=True)])


def range_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, on: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Points with every interval [start, end) that holds them.

    width: a bin width near the usual interval length; both sides are then dealt by
    bin, so the join is an equi-join with a residual filter and not a nested loop.
    """
    keys = list(on)
    held = (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    if width is None:
        return points.join(intervals, keys, "inner").where(held) if keys else points.join(intervals, held)
    a = points.withColumn("__bin", F.floor(F.col(time) / width))
    b = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return a.join(b, [*keys, "__bin"]).where(held).drop("__bin")


def hold_weights(df: DataFrame, by: Sequence[str], time: str, end: Column | None = None, name: str = "hold") -> DataFrame:
    """How long each sample holds: until the next of its key, the last until `end` (0 where end is not given)."""
    nxt = F.lead(time).over(Window.partitionBy(*by).orderBy(time))
    return df.withColumn(name, F.coalesce(nxt, end if end is not None else F.col(time)) - F.col(time))


def held_mean(df: DataFrame, by: Sequence[str], time: str, value: str, name: str = "held_mean") -> DataFrame:
    """Time-weighted mean of a left-held series; null where no time passes."""
    held = hold_weights(df, by, time, name="__h")
    return held.groupBy(*by).agg((F.sum(F.col(value) * F.col("__h")) / F.nullif(F.sum("__h"), F.lit(0))).alias(name))


def trapezoid_mean(df: DataFrame, by: Sequence[str], time: str, value: str, name: str = "trapezoid_mean") -> DataFrame:
    """Mean of a piecewise linear series over its span; null for fewer than two times."""
    w = Window.partitionBy(*by).orderBy(time)
    steps = df.withColumn("__dt", F.lead(time).over(w) - F.col(time)).withColumn("__v", (F.lead(value).over(w) + F.col(value)) / 2)
    return steps.groupBy(*by).agg((F.sum(F.col("__v") * F.col("__dt")) / F.nullif(F.sum("__dt"), F.lit(0))).alias(name))


def step_integral(df: DataFrame, by: Sequence[str], time: str, value: str, windows: DataFrame, start: str, end: str, width: float, name: str = "integral") -> DataFrame:
    """Integral of a left-held series over each window of the same key; the last sample holds for no time."""
    held = hold_weights(df, by, time, name="__h").where("__h > 0").withColumn("__e", F.col(time) + F.col("__h"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    a = held.select(*by, F.col(time).alias("__s"), "__e", F.col(value).alias("__v")).withColumn("__bin", bins(F.col("__s"), F.col("__e")))
    b = windows.withColumn("__bin", bins(F.col(start), F.col(end)))
    # A pair that shares several bins counts in the first of them.
    met = a.join(b, [*by, "__bin"]).where(F.col("__bin") == F.floor(F.greatest("__s", start) / width))
    part = F.greatest(F.least("__e", end) - F.greatest("__s", start), F.lit(0))
    return met.groupBy(*by, start, end).agg(F.sum(F.col("__v") * part).alias(name))


def interval_union(df: DataFrame, by: Sequence[str], start: str, end: str, name: str = "busy") -> DataFrame:
    """Length of the union of each key's intervals; empty and reversed intervals count nothing."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    new = df.where(F.col(end) > F.col(start)).withColumn("__r", reach)
    return new.groupBy(*by).agg(F.sum(F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("__r", start)), F.lit(0))).alias(name))


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Sessions: by, island (from 1), start, end and n of intervals that are at most `gap` apart."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("__n", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    numbered = new.withColumn("island", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def peak_concurrency(df: DataFrame, by: Sequence[str], start: str, end: str, name: str = "peak") -> DataFrame:
    """Most intervals open at once; at equal times ends come before starts."""
    edge = lambda c, d: df.where(F.col(end) > F.col(start)).select(*by, F.col(c).alias("__t"), F.lit(d).alias("__d"))
    run = F.sum("__d").over(Window.partitionBy(*by).orderBy("__t", "__d").rowsBetween(Window.unboundedPreceding, 0))
    return edge(start, 1).unionByName(edge(end, -1)).withColumn("__o", run).groupBy(*by).agg(F.max("__o").alias(name))


def harmonic_estimate(df: DataFrame, by: Sequence[str], time: str, value: str, last: int = 5, max_age: float | None = None, tie: str | None = None, startup: float | None = None) -> DataFrame:
    """Each row with the harmonic mean of its key's last `last` positive values no older than max_age, itself included.

    estimate_status: ready for `last` values, warming_up for fewer, stale where all
    are too old, bootstrap where there were none (estimate is then `startup`).
    """
    order = Window.partitionBy(*by).orderBy(*[c for c in (time, tie) if c])
    good = F.when(F.col(value) > 0, F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))
    recent = F.collect_list(good).over(order.rowsBetween(-(last - 1), 0))
    fresh = F.filter("__w", lambda x: (F.col(time) - x["t"]) <= max_age) if max_age is not None else F.col("__w")
    total = F.aggregate("__f", F.lit(0.0), lambda a, x: a + 1 / x["v"])
    status = F.when(F.size("__w") == 0, "bootstrap").when(F.size("__f") == 0, "stale").when(F.size("__f") < last, "warming_up").otherwise("ready")
    out = df.withColumn("__w", recent).withColumn("__f", fresh).withColumn("estimate_status", status)
    value_or_start = F.when(F.size("__f") > 0, F.size("__f") / total).when(F.size("__w") == 0, F.lit(startup))
    return out.withColumn("estimate", value_or_start).withColumn("n_used", F.size("__f")).drop("__w", "__f")


def moving_mean(df: DataFrame, by: Sequence[str], time: str, value: str, n: int = 5, tie: str | None = None, name: str = "moving_mean") -> DataFrame:
    """Mean of the last n rows; null until there are n."""
    frame = Window.partitionBy(*by).orderBy(*[c for c in (time, tie) if c]).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(frame) == n, F.avg(value).over(frame)))


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "changed") -> DataFrame:
    """Whether the value differs from the row before; the first row of a key has not changed."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, False).otherwise(~F.lag(value).over(w).eqNullSafe(F.col(value))))


def running_offset(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, name: str = "offset") -> DataFrame:
    """Sum of the sizes before a row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def pair_starts_with_ends(df: DataFrame, by: Sequence[str], time: str, kind: str, start: str, end: str, tie: str) -> DataFrame:
    """by, started, ended: each end with the latest start since the end before it; ends without one are left out."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    marks = df.where(F.col(kind).isin(start, end))
    before = F.lag(F.struct(F.col(kind).alias("k"), F.col(time).alias("t"))).over(w)
    paired = marks.withColumn("__b", before).where((F.col(kind) == end) & (F.col("__b.k") == start))
    return paired.select(*by, F.col("__b.t").alias("started"), F.col(time).alias("ended"))


def finish_times(df: DataFrame, by: Sequence[str], arrival: str, service: str, order: Sequence[str], name: str = "finish") -> DataFrame:
    """When a single server is done with each job, in order: max over earlier arrivals a_k of a_k + the service from k on."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("__s", F.sum(service).over(w))
    slack = F.max(F.col(arrival) - (F.col("__s") - F.col(service))).over(w)
    return total.withColumn(name, slack + F.col("__s")).drop("__s")


def looped_integral(steps: DataFrame, at: str, rate: str, length: float, spans: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """spans with the integral from start to end of a rate that steps at `at` (the first at 0) and goes round after `length`.

    steps is one trace of MOST_STEPS rows at most, which goes to every task as one array; a span is
    whole rounds and what is left of them on both sides. An end before its start
    gives the negative integral; a null end or no steps give null.
    """
    w = Window.orderBy(at)  # one trace
    until = F.coalesce(F.lead(at).over(w), F.lit(float(length))).cast("double")
    rows = steps.select(F.col(at).cast("double").alias("a"), until.alias("b"), F.col(rate).cast("double").alias("r"))
    trace = rows.withColumn("before", F.coalesce(F.sum((F.col("b") - F.col("a")) * F.col("r")).over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    whole = trace.agg(F.array_sort(F.collect_list(F.struct("a", "b", "r", "before"))).alias("__trace"), F.sum((F.col("b") - F.col("a")) * F.col("r")).alias("__total")).select(bounded("__trace").alias("__trace"), "__total")
    both = spans.join(F.broadcast(whole))  # one row

    def upto(c: str) -> Column:
        t = F.col(c).cast("double")
        rest = F.pmod(t, F.lit(float(length)))
        step = F.try_element_at(F.filter("__trace", lambda x: x["a"] <= rest), F.lit(-1))
        return F.floor(t / length) * F.col("__total") + step["before"] + (rest - step["a"]) * step["r"]

    return both.withColumn(name, upto(end) - upto(start)).drop("__trace", "__total")


def display_records(df: DataFrame, by: Sequence[str], wall: str, media: str, step: float, order: str) -> DataFrame:
    """by, frame, wall: for every multiple of `step` of media time between two rows of a group, the wall time in between, linear.

    A row (wall, media) begins the interval that the next one of its group ends; an
    interval in which media time stands still or goes back shows nothing.
    """
    w = Window.partitionBy(*by).orderBy(wall, order)
    rows = df.select(*by, F.col(wall).cast("double").alias("__w0"), F.col(media).cast("double").alias("__m0"), F.lead(F.col(wall).cast("double")).over(w).alias("__w1"), F.lead(F.col(media).cast("double")).over(w).alias("__m1"))
    first, last = F.ceil(F.col("__m0") / step), F.ceil(F.col("__m1") / step) - 1
    shown = rows.where((F.col("__m1") > F.col("__m0")) & (last >= first)).withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    part = (F.col("frame") * step - F.col("__m0")) / (F.col("__m1") - F.col("__m0"))
    return shown.select(*by, "frame", (F.col("__w0") + part * (F.col("__w1") - F.col("__w0"))).alias("wall"))


def sample_durations(df: DataFrame, by: Sequence[str], time: str, tie: str, explicit: str, rate: float, name: str = "duration") -> DataFrame:
    """How long each sample holds and why: its explicit duration, else until the next one's time, else 1 / rate; name and name_from (explicit, next, rate). Negative explicit durations do not count."""
    own = F.when(F.col(explicit) >= 0, F.col(explicit).cast("double"))
    gap = (F.lead(time).over(Window.partitionBy(*by).orderBy(time, tie)) - F.col(time)).cast("double")
    source = F.when(own.isNotNull(), "explicit").when(gap.isNotNull(), "next").otherwise("rate")
    return df.withColumns({name: F.coalesce(own, gap, F.lit(1.0 / rate)), f"{name}_from": source})


def stall_pairs(df: DataFrame, by: Sequence[str], time: str, tie: str, kind: str, start: str, end: str, shown: str, period: float, near: float) -> DataFrame:
    """by, started, ended, stalled, cause of each stall: a start with the next end; an end without one and a start that never ends are left out.

    cause: "startup" if nothing had been shown by then, "boundary" if it began within
    `near` after or before a multiple of `period`, else "feature". Of starts that follow
    each other without an end the first counts.
    """
    w = Window.partitionBy(*by).orderBy(time, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col(kind) == shown).over(before), F.lit(False))
    # A stall's number is how many ends came before it.
    number = F.coalesce(F.sum((F.col(kind) == end).cast("int")).over(before), F.lit(0))
    marks = df.withColumns({"__seen": seen, "__k": number}).where(F.col(kind).isin(start, end))
    starts = F.min(F.when(F.col(kind) == start, F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col("__seen").alias("seen"))))
    pairs = marks.groupBy(*by, "__k").agg(starts.alias("__s"), F.min(F.when(F.col(kind) == end, F.col(time))).alias("ended")).where("__s IS NOT NULL AND ended IS NOT NULL")
    phase = F.pmod(F.col("__s.t").cast("double"), F.lit(float(period)))
    cause = F.when(~F.col("__s.seen"), "startup").when((phase <= near) | (phase >= period - near), "boundary").otherwise("feature")
    return pairs.select(*by, F.col("__s.t").alias("started"), "ended", (F.col("ended") - F.col("__s.t")).alias("stalled"), cause.alias("cause"))
