import random
import time

import pytest
from pyspark.sql import functions as F

from tidelake.streaming import batches as b
from tidelake.streaming import states

SCHEMA = "key long, seq long, received double, ids array<string>, fault string, rate double"


def log(n, seed):
    r = random.Random(seed)
    return [(k % 3, k, float(k // 3 + r.choice([0, 0, 0, -4])), [f"i{r.randint(0, 3 * n)}" for _ in range(2)], r.choice([None, None, None, "partial"]), r.choice([1.0, 2.0, 8.0, None])) for k in range(n)]


def brute(rows):
    out, state = [], {}
    for key, seq, received, ids, fault, rate in rows:
        clock, seen, rates, n = state.get(key, (float("-inf"), set(), [], 0))
        fault = fault or ("repeated" if seen & set(ids) else None) or ("late" if received < clock else None)
        if fault is None:
            clock, seen, rates, n = received, seen | set(ids), (rates + [rate] * (rate is not None))[-5:], n + 1
            state[key] = clock, seen, rates, n
        out.append((key, seq, fault, n, round(len(rates) / sum(1 / x for x in rates), 9) if rates else None))
    return sorted(out)


def plain(df):
    return sorted((r.key, r.seq, r.fault, r.n_accepted, None if r.estimate is None else round(r.estimate, 9)) for r in df.collect())


def test_fold_over_a_table(spark):
    rows = log(200, 1)
    want = brute(rows)
    assert {r[2] for r in want} == {None, "partial", "repeated", "late"}
    assert plain(b.fold(spark.createDataFrame(rows, SCHEMA).repartition(5))) == want
    assert b.fold(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_gives_the_rows_of_the_table(spark, rocks, tmp_path):
    rows = log(60, 2)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    assert plain(states.drained(b.observe(stream), "observed", "update", f"{tmp_path}/c")) == brute(rows)


def test_batches_from_transfers(spark):
    rows = [
        (1, 1, 9.0, "a", 4, 4, 0.0, 2.0), (1, 1, 9.0, "b", 4, 4, 1.0, 3.0), (1, 1, 9.0, "c", 4, 4, 7.0, 8.0),
        (1, 2, 9.0, "d", 4, 3, 0.0, 2.0), (1, 3, 9.0, "e", 4, 4, 0.0, 9.5), (1, 4, 9.0, "f", 4, 4, 2.0, 2.0), (1, 5, 9.0, "g", 4, 4, 2.0, 3.0), (1, 5, 9.0, "g", 4, 4, 2.0, 3.0), (1, 6, 9.0, "h", 4, 4, None, 3.0), (1, 7, 9.0, "i", 0, 0, 2.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "k long, s long, at double, id string, want long, got long, a double, z double")
    got = {r.seq: (r.fault, r.rate, r.ids) for r in b.batches(df, "k", "s", "at", "id", "want", "got", "a", "z").collect()}
    assert got == {1: (None, 3.0, ["a", "b", "c"]), 2: ("partial", None, ["d"]), 3: ("future", None, ["e"]), 4: ("interval", None, ["f"]), 5: ("repeated", None, ["g"]), 6: ("interval", None, ["h"]), 7: (None, None, ["i"])}


def test_an_idle_key_is_told_once(spark, rocks, tmp_path):
    spark.createDataFrame(log(3, 3)[:1], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/0")
    stream = b.observe(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*"), idle_ms=1)
    run = stream.writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            if run.exception() is not None or spark.table("idle").where(F.col("fault") == "idle").count():
                break
            time.sleep(0.2)
            if not _ % 10:
                spark.createDataFrame([(9, 100 + _, 1.0, ["z"], None, 1.0)], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{_ + 1}")
        assert run.exception() is None
        told = spark.table("idle").where("fault = 'idle' AND key = 0").collect()
        assert len(told) == 1 and told[0].estimate is None
    finally:
        run.stop()
