"""Event-time work that runs alike over batches and streams, and the queries that drive it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of value by time window; late: how long a window stays open in a stream."""
    source = events.withWatermark(time, late) if late else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return source.groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Events of which each id counts once; ids are forgotten when the watermark has passed them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


ESTIMATE = "user_id long, seen long, rejected long, estimate double"
ESTIMATE_STATE = "clock double, values array<double>, seen long, rejected long"


def causal_estimate(events: DataFrame, last: int = 5) -> DataFrame:
    """ESTIMATE of each user after each batch: harmonic mean of the last positive values in order of time.

    An event older than the newest one already counted is rejected and counted as
    such: time never runs backwards, so an estimate never changes in retrospect.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, values, seen, rejected = state.get if state.exists else (float("-inf"), [], 0, 0)
        values = list(values)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        for t, value in zip(rows["t"], rows["value"], strict=True):
            if t < clock:
                rejected += 1
                continue
            clock, seen = t, seen + 1
            if value > 0:
                values = [*values, float(value)][-last:]
        state.update((float(clock), values, int(seen), int(rejected)))
        estimate = len(values) / sum(1 / v for v in values) if values else None
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "rejected": [rejected], "estimate": [estimate]})

    return events.groupBy("user_id").applyInPandasWithState(update, ESTIMATE, ESTIMATE_STATE, "update", GroupStateTimeout.NoTimeout)


def playback(segments: DataFrame, startup_s: float = 4.0) -> DataFrame:
    """user_id, started, stalled_s, n_stalls and played_s of each user: a buffer that fills with each segment (t: when it is there, media_s: how long it plays) and drains in real time.

    Play starts once startup_s are buffered, or with the last segment; it stalls
    when the buffer is empty until the next segment. All that is buffered has been
    played by the sum of media so far plus the largest lag of a segment's arrival
    behind the media before it, which is a running maximum; a segment that arrives
    later than that ends a stall.
    """
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = segments.select("user_id", "event_id", "t", "media_s").withColumns({"have": F.sum("media_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("t").over(w).isNull()})
    marks = sums.withColumn("ready", (F.col("have") >= startup_s) | F.col("last"))
    begun = marks.withColumn("begun", F.coalesce(F.max("ready").over(past), F.lit(False)))
    lag = F.when(F.col("begun"), F.col("t") - (F.col("have") - F.col("media_s"))).when(F.col("ready"), F.col("t"))
    known = begun.withColumn("lag", lag).withColumn("held", F.max("lag").over(past))
    stall = F.when(F.col("begun") & (F.col("lag") > F.col("held") + 1e-9), F.col("lag") - F.col("held"))
    start = F.min(F.when(F.col("ready") & ~F.col("begun"), F.col("t")))
    return known.withColumn("stall", stall).groupBy("user_id").agg(start.alias("started"), F.coalesce(F.sum("stall"), F.lit(0.0)).alias("stalled_s"), F.count("stall").alias("n_stalls"), F.sum("media_s").alias("played_s"))


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what its source has now, to a memory table of this name, and gives the table."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.table(name)
