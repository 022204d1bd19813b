import pytest
from pyspark.sql import functions as F

from tidelake.streaming import states

SCHEMA = "event_id long, user_id long, t double, ts timestamp, value double, event_type string"


@pytest.fixture
def source(spark, tmp_path):
    """Three files of events, read one a batch; the last has late and repeated ones."""
    files = [
        [(1, 1, 0.0, 4.0), (2, 1, 10.0, 2.0), (3, 2, 5.0, 8.0)],
        [(4, 1, 4000.0, 1.0), (5, 2, 4100.0, 0.0)],
        [(6, 1, 100.0, 9.0), (4, 1, 4000.0, 1.0), (7, 2, 90000.0, 5.0)],
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, u, t, v, "x") for i, u, t, v in rows], "event_id long, user_id long, t double, value double, event_type string")
        df.withColumn("ts", F.timestamp_micros(((F.col("t") + 3_600_000) * 1e6).cast("long"))).select("event_id", "user_id", "t", "ts", "value", "event_type").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")


def test_windows_over_stream_and_batch_agree(spark, source, tmp_path):
    out = states.drained(states.windowed(source(), "ts", "1 hour", late="2 hours"), "hours", "update", f"{tmp_path}/c1")
    last = out.groupBy("window").agg(F.max("n").alias("n"))
    batch = states.windowed(spark.read.schema(SCHEMA).json(f"{tmp_path}/in/*"), "ts", "1 hour")
    assert sorted((str(r["window"].start), r.n) for r in last.collect()) == sorted((str(r["window"].start), r.n) for r in batch.collect())


def test_each_id_counts_once(source, tmp_path):
    out = states.drained(states.once(source(), "event_id", "ts", "2 days"), "once", "append", f"{tmp_path}/c2")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_sessions_close_when_the_watermark_passes(source, tmp_path):
    out = states.drained(states.sessions(source(), "ts", "30 minutes", "user_id", late="1 hour"), "sess", "append", f"{tmp_path}/c3")
    closed = {(r.user_id, r["session_window"].start.minute, r.n) for r in out.collect()}
    assert (1, 0, 2) in closed or (1, 0, 3) in closed
    assert (2, 0, 1) in closed


def test_causal_estimates_reject_what_comes_late(source, tmp_path):
    out = states.drained(states.causal_estimate(source()), "est", "update", f"{tmp_path}/c4")
    best = {}
    for r in out.collect():
        if r.user_id not in best or r.seen + r.rejected > best[r.user_id].seen + best[r.user_id].rejected:
            best[r.user_id] = r
    one, two = best[1], best[2]
    assert one.seen + one.rejected == 5 and one.rejected >= 1
    assert two.seen == 3 and two.rejected == 0 and abs(two.estimate - 2 / (1 / 8 + 1 / 5)) < 1e-9


def brute_playback(rows, startup):
    """Second by second."""
    arrivals, buffered, started, stalled, stalls, played, stalling = dict(rows), 0, None, 0, 0, 0, False
    last = max(arrivals)
    for t in range(last + 1):
        buffered += arrivals.get(t, 0)
        stalling = stalling and t not in arrivals
        if started is None and (buffered >= startup or t == last):
            started = t
        if started is not None and t < last:
            if buffered:
                buffered, played = buffered - 1, played + 1
            else:
                stalled, stalls, stalling = stalled + 1, stalls + (not stalling), True
    return started, stalled, stalls, played + buffered


def test_playback_against_ticks(spark):
    import random

    r = random.Random(3)
    want, rows = {}, []
    for u in range(12):
        times = sorted(r.sample(range(60), r.randint(1, 9)))
        own = [(t, r.randint(1, 8)) for t in times]
        want[u] = brute_playback(own, 6)
        rows += [(u, k, float(t), float(m)) for k, (t, m) in enumerate(own)]
    got = states.playback(spark.createDataFrame(rows, "user_id long, event_id long, t double, media_s double"), 6.0).collect()
    assert {x.user_id: (x.started, x.stalled_s, x.n_stalls, x.played_s) for x in got} == want
