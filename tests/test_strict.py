from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidelake.functions import providers
from tidelake.functions.strict import strict_json
from tidelake.operators import timeline
from tidelake.sources import files


def test_strict_json(spark):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', '{"a": NaN}', '{"a": Infinity}', '{"a": 1} x', '{"a": 1}, {"a": 2}', "", "{'a': 1}", '{"a": 01}', None, '{"a": "' + "x" * 60 + '"}', "null", "[1, 2]", '{"a": 1}]', ' {"a": 1}\n']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strict_json(F.col("t"), 50).alias("j")).select("i", "j.fault", F.col("j.value").cast("string").alias("v")).collect()
    faults = {r.i: r.fault for r in rows}
    assert [i for i, f in sorted(faults.items()) if f is None] == [0, 12, 13, 15]
    assert faults[10] == "missing" and faults[11] == "too long" and {faults[i] for i in (*range(1, 10), 14)} == {"malformed"}


def test_strict_files(spark, tmp_path):
    for name, text in (("good", '{"id": "x", "n": 3}'), ("twice", '{"id": "x", "id": "y", "n": 3}'), ("nan", '{"id": "x", "n": NaN}'), ("long", '{"id": "' + "x" * 100 + '", "n": 3}'), ("other", '{"id": "x", "n": "three"}')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name: files.strict_documents(spark, f"{tmp_path}/{name}.json", "id string, n int", max_bytes=80)
    assert [(r.document.id, r.document.n) for r in read("good").collect()] == [("x", 3)]
    for name, what in (("twice", "not strict"), ("nan", "not strict"), ("long", "too long"), ("other", "does not fit")):
        with pytest.raises(ValueError, match=what):
            read(name).collect()
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2, "n": 2}\n{"id": "c", "n": {}}\n')
    good, bad = files.strict_lines(spark, f"{tmp_path}/l.jsonl", "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and sorted(r.fault for r in bad.collect()) == ["malformed", "schema"]


def expand(entries, end):
    """(number, start, length) of sound entries, piece by piece."""
    out, at = [], 0
    for k, (t, d, r) in enumerate(entries):
        at = at if t is None else t
        stop = entries[k + 1][0] if k + 1 < len(entries) else end
        n = (r or 0) + 1
        while n > 0 or r == -1 and at < stop:
            length = min(d, stop - at) if r == -1 else d
            out.append((len(out), at, length))
            at, n = at + length, n - 1
    return out


def test_run_length_timelines(spark):
    cases = {"a": [(None, 10, 2), (None, 5, None), (100, 7, 0)], "b": [(5, 10, -1), (38, 4, 1), (None, 3, -1)], "c": [(0, 20, 4)]}
    df = spark.createDataFrame([(c, k, *e, 60) for c, es in cases.items() for k, e in enumerate(es)], "rep string, place int, t long, d long, r long, end long")
    got = timeline.expanded(df, ["rep"], "place", "t", "d", "r", "end").collect()
    for c, es in cases.items():
        assert sorted((x.number, x.start, x.length) for x in got if x.rep == c) == expand(es, 60)
    assert [(x.rep, x.number, x.fault) for x in got if x.fault] == [("a", 4, "gap")]
    bad = spark.createDataFrame([("x", 0, None, 0, 1, None), ("x", 1, None, 5, -1, None), ("x", 2, None, 5, -2, None), ("x", 3, -3, 5, 0, None)], "rep string, place int, t long, d long, r long, end long")
    assert [x.fault for x in timeline.expanded(bad, ["rep"], "place", "t", "d", "r", "end").orderBy("number").collect()] == ["length", "repeat", "repeat", "overlap"]


def test_timelines_are_sorted_once(spark):
    # Places of two columns, and spans that fit a long within a run but not over all runs of a key.
    long = 1 << 62
    rows = [("a", 1, 1, 5, long, 0), ("a", 1, 2, None, 7, 1), ("a", 2, 0, 9, long, 0), ("a", 2, 4, 30, 10, -1)]
    df = spark.createDataFrame(rows, "rep string, x int, y int, t long, d long, r long").withColumn("end", F.lit(45))
    out = timeline.expanded(df, ["rep"], ["x", "y"], "t", "d", "r", "end")
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = sorted(tuple(r)[1:] for r in out.collect())
    assert got == [(0, 5, long, None), (1, 5 + long, 7, None), (2, 12 + long, 7, None), (3, 9, long, "overlap"), (4, 30, 10, "overlap"), (5, 40, 5, None)]


MPD = """<?xml version="1.0"?><MPD xmlns="{ns}" profiles="urn:a, urn:b" mediaPresentationDuration="PT1M2.5S"><Period><AdaptationSet>
<Representation id="r1" bandwidth="100"><SegmentTemplate timescale="10"><SegmentTimeline><S t="0" d="100" r="2"/><S d="50" r="-1"/></SegmentTimeline></SegmentTemplate></Representation>
<Representation id="r2" bandwidth="200"><SegmentTemplate timescale="10"><SegmentTimeline><S d="600"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet></Period></MPD>"""


def test_manifest_timelines_against_an_index(spark, tmp_path):
    (tmp_path / "good.mpd").write_text(MPD.format(ns=files.MPD_NAMESPACE))
    (tmp_path / "other.mpd").write_text(MPD.format(ns="urn:other"))
    entries, reps = files.manifest_timelines(spark, f"{tmp_path}/good.mpd", "urn:b")
    assert sorted((r.representation, r.bandwidth, r.timescale) for r in reps.collect()) == [("r1", 100, 10), ("r2", 200, 10)]
    pieces = timeline.expanded(entries, ["representation"], "place", "t", "d", "r", "end")
    starts = [0, 100, 200, *range(300, 625, 50)]
    assert sorted((r.start, r.length) for r in pieces.where("representation = 'r1'").collect()) == [(s, 100 if s < 300 else min(50, 625 - s)) for s in starts]
    index = [("r1", k, s + (k == 2), 100 if s < 300 else min(50, 625 - s)) for k, s in enumerate(starts) if k != 5] + [("r2", 0, 0, 599), ("r2", 1, 600, 1)]
    faults = timeline.timeline_faults(pieces, spark.createDataFrame(index, "representation string, number long, start long, length long"), ["representation"])
    assert sorted(tuple(r) for r in faults.collect()) == [("r1", 2, "start"), ("r1", 5, "not indexed"), ("r2", 0, "length differs"), ("r2", 1, "not in the timeline")]
    for path, profile, what in (("other", None, "namespace"), ("good", "urn:c", "profile")):
        with pytest.raises(ValueError, match=what):
            files.manifest_timelines(spark, f"{tmp_path}/{path}.mpd", profile)


def test_a_provider_of_ones_own(spark):
    class Ratio(providers.Provider):
        needs = ("a", "b")

        def value(self, a, b, *, scale: float = 1.0):
            return (None, "no b") if b == 0 else (scale * a / b, None)

    providers.register(spark, "ratio", Ratio())
    spark.createDataFrame([("x", 1, 2.0), ("y", 3, 0.0), ("z", None, 1.0)], "k string, a int, b double").createOrReplaceTempView("ratios")
    got = spark.sql("SELECT * FROM ratio(TABLE(ratios), scale => 4)").collect()
    assert sorted((r.k, r.value, r.reason) for r in got) == [("x", 2.0, None), ("y", None, "no b"), ("z", None, "missing a")]
    for text, what in (("SELECT * FROM ratio(TABLE(SELECT k, a FROM ratios))", "number column b"), ("SELECT * FROM ratio(TABLE(ratios), other => 1)", "no option other"), ("SELECT * FROM ratio(TABLE(SELECT *, 1 AS value FROM ratios))", "which is there")):
        with pytest.raises(Exception, match=what):
            spark.sql(text).collect()


def test_a_provider_over_batches(spark):
    class Ratio(providers.Provider):
        needs = ("a", "b")

        def value(self, a, b, *, scale: float = 1.0):
            return (None, "no b") if b == 0 else (scale * a / b, None)

    nan, inf = float("nan"), float("inf")
    d = [Decimal("0.1"), Decimal("12345678901234.567"), Decimal("7"), None]
    numbers = [1.5, 0.0, -2.0, nan, inf, -inf, 1e300, None]
    rows = [(k, d[k % 4], numbers[k % 8], numbers[k // 8 % 8], numbers[k // 64 % 8], (1 << 60) + k) for k in range(512)]
    df = spark.createDataFrame(rows, "k int, weight decimal(20,5), visible double, pixels double, base double, own long")
    two = spark.createDataFrame([("x", 1, 2.0), ("y", 3, 0.0), ("z", None, 1.0), ("u", 1, None)], "k string, a int, b double")
    cases = [(providers.Density(), df, "most => 2.5"), (Ratio(), two, "scale => 4"), (providers.Quality(), df.selectExpr("k", "visible AS seen", "base AS base_error", "pixels AS error"), "floor => 0.5")]
    for provider, rows, option in cases:
        providers.register(spark, "by_row", provider)
        providers.register(spark, "by_batch", provider, rows.schema)
        by_row, by_batch = (spark.sql(f"SELECT * FROM {f}(TABLE(SELECT * FROM {{rows}}), {option})", rows=rows) for f in ("by_row", "by_batch"))
        assert "ArrowEvalPythonUDTF" in by_batch._jdf.queryExecution().executedPlan().toString()
        assert by_batch.dtypes == by_row.dtypes
        assert sorted(map(repr, by_batch.collect())) == sorted(map(repr, by_row.collect()))
    with pytest.raises(ValueError, match="number column b"):
        providers.register(spark, "by_batch", Ratio(), two.select("k", "a").schema)
    with pytest.raises(ValueError, match="column reason"):
        providers.register(spark, "by_batch", Ratio(), two.withColumn("reason", F.lit(1)).schema)
    providers.register(spark, "by_batch", Ratio(), two.schema)
    for text, what in (("SELECT * FROM by_batch(TABLE(SELECT * FROM {rows}), other => 1)", "no option other"), ("SELECT * FROM by_batch(TABLE(SELECT b, a, k FROM {rows}))", "takes the columns")):
        with pytest.raises(Exception, match=what):
            spark.sql(text, rows=two).collect()


def test_densities_are_provided_by_batches(spark):
    plan = entry.queries()["provided_densities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan
