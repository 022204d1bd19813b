"""A causal estimate from batches of transfers that count whole or not at all.

A batch is refused if one of its transfers is partial, ends after the batch was received,
has no sound interval, or has an id that the batch has twice or an accepted batch had; or
if it was received before an accepted one. A refused batch changes nothing. What can be
told from a batch alone is worked out by Spark's own aggregates; only the order of batches
needs state. observe() keeps it in a stream, fold() over a table; both step alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidelake.operators.temporal import interval_union

FAULTS = ("partial", "future", "interval", "repeated", "late")
OUT = "key long, seq long, fault string, n_accepted long, estimate double"
#: Samples that an estimate is made of.
LAST = 5


def batches(transfers: DataFrame, key: str, seq: str, received: str, id_col: str, wanted: str, got: str, start: str, end: str) -> DataFrame:
    """key, seq, received, ids, fault, rate: one row a batch of transfers; rate is what came in by the time that at least one of them took.

    fault is the first of FAULTS that the batch shows by itself, else null; a batch is as
    large as its transfers are many, so ids is an array of bounded length by its meaning.
    """
    by = ["key", "seq"]
    rows = transfers.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(received).cast("double").alias("received"), F.col(id_col).cast("string").alias("id"), F.col(wanted).cast("double").alias("wanted"), F.col(got).cast("double").alias("got"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"))
    any_ = lambda bad: F.max(F.coalesce(bad, F.lit(True)))
    bad = F.when(any_(F.col("got") != F.col("wanted")), "partial").when(any_(F.col("end") > F.col("received")), "future")
    bad = bad.when(any_((F.col("start") > F.col("end")) | (F.col("start") < 0) | (F.col("wanted") > 0) & (F.col("end") == F.col("start"))), "interval")
    bad = bad.when(F.count_distinct("id") < F.count("*"), "repeated")
    sums = rows.groupBy(*by).agg(F.max("received").alias("received"), F.array_sort(F.collect_set("id")).alias("ids"), bad.alias("fault"), F.sum("got").alias("got"))
    busy = interval_union(rows, by, "start", "end")
    return sums.join(busy, by, "left").select(*by, "received", "ids", "fault", F.when(F.col("fault").isNull() & (F.col("busy") > 0), F.col("got") / F.col("busy")).alias("rate"))


def step(clock: float, seen, row, rates: list[float]) -> tuple[str | None, float, list[float]]:
    """(fault, clock, rates) after a batch; seen tells whether an accepted batch had an id."""
    fault = row.fault
    if fault is None and any(seen(i) for i in row.ids):
        fault = "repeated"
    if fault is None and row.received < clock:
        fault = "late"
    if fault is not None:
        return fault, clock, rates
    return None, row.received, ([*rates, row.rate] if row.rate is not None and row.rate > 0 else rates)[-LAST:]


def harmonic(rates: list[float]) -> float | None:
    return len(rates) / sum(1 / r for r in rates) if rates else None


def _clean(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({"fault": object, "rate": object}).where(rows.notna(), None)


def fold(table: DataFrame) -> DataFrame:
    """OUT of each batch, in order of seq. A key's batches pass through one task, sorted by Spark, and only the state is held, however many there are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, clock, seen, rates, n = object(), 0.0, set(), [], 0
        for part in parts:
            out = []
            for row in _clean(part).itertuples(index=False):
                if row.key != key:
                    key, clock, seen, rates, n = row.key, float("-inf"), set(), [], 0
                fault, clock, rates = step(clock, seen.__contains__, row, rates)
                if fault is None:
                    n += 1
                    seen.update(row.ids)
                out.append((row.key, row.seq, fault, n, harmonic(rates)))
            yield pd.DataFrame(out, columns=["key", "seq", "fault", "n_accepted", "estimate"])

    ready = table.select("key", "seq", "received", "ids", "fault", "rate").where("key IS NOT NULL")
    return ready.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, OUT)


class Observer(StatefulProcessor):
    """fold() in a stream: a value for the clock, a map of the ids that were accepted, a list of rates, and a timer that forgets a key's rates once it has been idle."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "received double, n long")
        self.seen = handle.getMapState("seen", "id string", "seq long")
        self.rates = handle.getListState("rates", "rate double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        clock, n = self.clock.get() if self.clock.exists() else (float("-inf"), 0)
        rates, out = [r[0] for r in self.rates.get()], []
        for row in _clean(pd.concat(list(rows)).sort_values("seq")).itertuples(index=False):
            fault, clock, rates = step(clock, lambda i: self.seen.containsKey((i,)), row, rates)
            if fault is None:
                n += 1
                for i in row.ids:
                    self.seen.updateValue((i,), (int(row.seq),))
            out.append((row.key, row.seq, fault, n, harmonic(rates)))
        self.clock.update((float(clock), int(n)))
        self.rates.clear()
        if rates:
            self.rates.put([(float(r),) for r in rates])
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "fault", "n_accepted", "estimate"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.rates.clear()
        n = self.clock.get()[1] if self.clock.exists() else 0
        yield pd.DataFrame({"key": [key[0]], "seq": pd.array([None], "Int64"), "fault": ["idle"], "n_accepted": [n], "estimate": pd.array([None], "Float64")})

    def close(self) -> None:
        pass


def observe(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """OUT of the batches of a stream of rows as of batches(), each row a whole batch, after every trigger. Needs the RocksDB state store.

    Batches of one trigger are taken by seq; one of an earlier seq that comes in a later
    trigger is judged when it comes. With idle_ms, a key that has sent nothing for so long
    gives a row of fault "idle" and starts its estimate anew; its clock and ids stay.
    """
    return stream.groupBy("key").transformWithStateInPandas(Observer(idle_ms), outputStructType=StructType.fromDDL(OUT), outputMode="update", timeMode="none" if idle_ms is None else "processingTime")


