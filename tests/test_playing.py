import random

import pytest
from pyspark.sql import functions as F

from tidelake.operators import clock, scan, timeline


def simulated(rows, step, ticks):
    """The clock, command by command."""
    playing, since, tick, due, stalled, n, out = True, None, 0, None, 0, 0, []
    for i, t, c, x in rows:
        open_ = since
        if c in ("pause", "seek", "unstall", "frame") and since is not None:
            stalled, since, due = stalled + t - since, None, t
        if c == "play":
            playing, due = True, t
        elif c == "pause":
            playing = False
        elif c == "seek":
            tick, due = max(0, min(x, ticks - 1)), t
        elif c == "stall" and playing and open_ is None:
            since, n = t, n + 1
        elif c == "frame":
            tick, due = (tick + 1) % ticks, max(t, (due if due is not None else t - step) + step)
        out.append((i, 2 if since is not None else int(playing), tick, due, stalled + (t - since if since is not None else 0), n))
    return out


@pytest.mark.parametrize("chunk", [512, 3])
def test_clock(spark, chunk):
    r, rows, want = random.Random(chunk), [], []
    for user in (1, None):
        t, mine = 0, []
        for k in range(200):
            t += r.randint(0, 30)
            mine.append((k + (1000 if user else 0), t, r.choice([*clock.COMMANDS, "frame", "stall", "other"]), r.randint(-5, 25)))
        want += simulated(mine, 10, 20)
        rows += [(user, *m) for m in mine]
    df = spark.createDataFrame(rows, "u int, i long, t long, c string, x long")
    got = clock.run_clock(df, ["u"], ["t", "i"], "c", "t", "x", 10, 20, chunk).select("i", "mode", "tick_now", "deadline", "stalled_total", "n_stalls")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_scan_keeps_the_order_of_what_does_not_commute(spark):
    rows = [(k % 2, k, [chr(97 + k % 26)]) for k in range(300)]
    got = scan.composed_scan(spark.createDataFrame(rows, "u int, k int, word array<string>"), ["u"], ["k"], "word", lambda a, b: F.concat(a, b), "all", 4).collect()
    for u in (0, 1):
        last = max((r for r in got if r.u == u), key=lambda r: r.k)
        assert "".join(last["all"]) == "".join(r[2][0] for r in rows if r[0] == u)


def test_segments_add_up_and_hold_their_points(spark):
    rows = [(k, s, p, t) for k, (s, p, t) in enumerate([(10, 3, 25), (10, 10, 10), (7, 20, 30), (5, 5, 1), (0, 1, 5), (12, 4, 24)])]
    df = spark.createDataFrame(rows, "k int, s long, p long, t long")
    got = timeline.looping_segments(df, ["k"], "s", "p", "t").collect()
    for k, s, p, t in rows:
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.segment)
        if not s:
            assert not mine
            continue
        assert [r.segment for r in mine] == list(range(len(mine)))
        assert sum(r.end - r.start for r in mine) == t and all(a.end == b.start for a, b in zip(mine, mine[1:]))
        cuts = {x for x in range(t) if x % s == 0 or x % s % p == 0}
        assert {r.start for r in mine} == cuts
        points = timeline.located(spark.createDataFrame([(x, s, p) for x in range(t)], "x long, s long, p long"), "x", "s", "p").collect()
        for r in points:
            home = mine[r.segment]
            assert home.start <= r.x < home.end and (home.loop, home.gop) == (r.loop, r.gop) and home.content_start <= r.content_time < home.content_end
