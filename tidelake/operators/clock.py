"""A scene clock: what commands do to the place, the deadline and the stalls of a playback.

A clock is paused, runs or is stalled; it holds a tick of a looped timeline, the time its
next frame is due, how long and how often it has stalled. A command is a transition: for
each of the three modes that it may meet, the mode after it and what it adds. Deadlines are
functions max(d + shift, least), which compose to such functions; ticks are set or moved on
round the loop. So commands compose, and series of any length are scanned in chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators.scan import composed_scan

COMMANDS = ("play", "pause", "seek", "stall", "unstall", "frame")
PAUSED, RUNNING, STALLED = 0, 1, 2
#: Below every time; `least` where a deadline is only shifted.
_NEVER = -(1 << 62)

#: For one mode: the mode after; time stalled, and how often a stall that was met open ends (its start is then taken off); the start of a stall that is left open; stalls begun; the deadline's shift and least; the tick set, and how far it moves on.
BRANCH = "struct<mode:int,stalled:bigint,ends:int,since:bigint,begun:int,shift:bigint,least:bigint,set:bigint,moves:bigint>"


def _branch(mode: int, stalled: Column | int = 0, ends: int = 0, since: Column | None = None, begun: int = 0, shift: int = 0, least: Column | int = _NEVER, set_: Column | None = None, moves: int = 0) -> Column:
    none = F.lit(None).cast("long")
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(mode).cast("int").alias("mode"), lit(stalled, "long").alias("stalled"), F.lit(ends).cast("int").alias("ends"), (none if since is None else since.cast("long")).alias("since"), F.lit(begun).cast("int").alias("begun"), lit(shift, "long").alias("shift"), lit(least, "long").alias("least"), (none if set_ is None else set_.cast("long")).alias("set"), lit(moves, "long").alias("moves"))


def transition(command: Column, at: Column, tick: Column, step: int, ticks: int) -> Column:
    """Branches of a command at a time; tick: where a seek goes, held to the timeline of `ticks` ticks; a frame moves the deadline by step. Unknown commands change nothing."""
    goal = F.greatest(F.lit(0), F.least(tick, F.lit(ticks - 1)))
    due = {"least": at, "shift": _NEVER // 2}
    ended = {"stalled": at, "ends": 1}
    branches = {
        "play": [_branch(RUNNING, **due), _branch(RUNNING, **due), _branch(STALLED, **due)],
        "pause": [_branch(PAUSED), _branch(PAUSED), _branch(PAUSED, **ended, **due)],
        "seek": [_branch(PAUSED, set_=goal, **due), _branch(RUNNING, set_=goal, **due), _branch(RUNNING, set_=goal, **ended, **due)],
        "stall": [_branch(PAUSED), _branch(STALLED, since=at, begun=1), _branch(STALLED)],
        "unstall": [_branch(PAUSED), _branch(RUNNING), _branch(RUNNING, **ended, **due)],
        "frame": [_branch(PAUSED, moves=1, shift=step, least=at), _branch(RUNNING, moves=1, shift=step, least=at), _branch(RUNNING, moves=1, shift=_NEVER // 2, least=at + step, **ended)],
    }
    idle = F.array(*[_branch(m) for m in (PAUSED, RUNNING, STALLED)])
    out = F.when(F.lit(False), idle)
    for name in COMMANDS:
        out = out.when(command == name, F.array(*branches[name]))
    return out.otherwise(idle).cast(f"array<{BRANCH}>")


def compose(first: Column, then: Column, ticks: int) -> Column:
    """What two transitions do one after the other."""

    def both(a: Column) -> Column:
        b = then[a["mode"]]
        opened = (b["ends"] == 1) & a["since"].isNotNull()
        return F.struct(
            b["mode"].alias("mode"),
            (a["stalled"] + b["stalled"] - F.when(opened, a["since"]).otherwise(0)).alias("stalled"),
            (a["ends"] + F.when(opened, 0).otherwise(b["ends"])).cast("int").alias("ends"),
            F.when(b["since"].isNotNull(), b["since"]).when(b["mode"] == STALLED, a["since"]).alias("since"),
            (a["begun"] + b["begun"]).alias("begun"),
            F.greatest(a["shift"] + b["shift"], F.lit(_NEVER // 2)).alias("shift"),
            F.greatest(F.when(a["least"] > _NEVER, a["least"] + b["shift"]).otherwise(_NEVER), b["least"]).alias("least"),
            F.coalesce(b["set"], a["set"]).alias("set"),
            F.when(b["set"].isNotNull(), b["moves"]).otherwise(F.pmod(a["moves"] + b["moves"], F.lit(ticks))).alias("moves"),
        )

    return F.transform(first, both)


def run_clock(commands: DataFrame, by: Sequence[str], order: Sequence[str], command: str, at: str, tick: str, step: int, ticks: int, chunk: int = 512) -> DataFrame:
    """commands with mode, tick_now, deadline, stalled_total (an open stall included) and n_stalls after each.

    Times are whole numbers of one unit, and at follows `order`. A clock begins running at
    tick 0, with no deadline until a command sets one; frames go round the loop of `ticks`
    ticks, `step` apart, and a late one is followed by one that is due at once.
    """
    marked = commands.withColumn("__does", transition(F.col(command), F.col(at), F.col(tick), step, ticks))
    ran = composed_scan(marked, by, order, "__does", lambda a, b: compose(a, b, ticks), "__run", chunk)
    r = F.col("__run")[RUNNING]
    due = F.when(r["least"] > _NEVER, r["least"])
    return ran.select(
        *commands.columns,
        r["mode"].alias("mode"),
        F.pmod(F.coalesce(r["set"], F.lit(0)) + r["moves"], F.lit(ticks)).alias("tick_now"),
        due.alias("deadline"),
        (r["stalled"] + F.when(r["mode"] == STALLED, F.col(at) - r["since"]).otherwise(0)).alias("stalled_total"),
        r["begun"].alias("n_stalls"),
    )
