"""Resource tables, exports, lookups and checks against small cases worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalars
from tidelake.operators import metrics, planning, relational, reports, runs, temporal
from tidelake.sources import files, sinks


def profile(resources, wanted=("a",)):
    return {"resources": resources, "instances": [{"instance_id": "i", "gops": [{"gop_id": "g", "qualities": [{"quality_id": "q0", "sse": 1.0, "resource_ids": list(wanted)}]}]}]}


def test_profile_resources_with_closure(spark, tmp_path):
    table = [{"resource_id": "a", "bytes": 5, "depends_on": ["b"]}, {"resource_id": "b", "bytes": 6, "depends_on": ["c"]}, {"resource_id": "c", "bytes": 7}, {"resource_id": "d", "bytes": 8}]
    (tmp_path / "p.json").write_text(json.dumps(profile(table)))
    resources, needs = files.profile_resources(spark, f"{tmp_path}/p.json")
    assert sorted((r.resource_id, r.bytes) for r in resources.collect()) == [("a", 5), ("b", 6), ("c", 7), ("d", 8)]
    assert sorted((r.quality_id, r.resource_id, r.depth) for r in needs.collect()) == [("q0", "a", 0), ("q0", "b", 1), ("q0", "c", 2)]
    for bad, what in ((table + [table[0]], "repeat"), ([{"resource_id": "a"}], "without bytes"), ([{"resource_id": "a", "bytes": 1, "depends_on": ["z"]}], "cannot be had"), ([{"resource_id": "a", "bytes": 1, "depends_on": ["a"]}], "cannot be had"), (table[3:], "unknown resource")):
        (tmp_path / "bad.json").write_text(json.dumps(profile(bad)))
        with pytest.raises(ValueError, match=what):
            files.profile_resources(spark, f"{tmp_path}/bad.json")


def test_visibility_series_as_json(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"time_s": 0, "instance_id": "a", "weight": 0.5}\n{"time_s": 1, "weights": {"a": 0.25, "b": 1}}\n')
    got = files.visibility_series(spark, f"{tmp_path}/v.jsonl")
    assert sorted(tuple(r) for r in got.collect()) == [(0.0, "a", 0.5), (1.0, "a", 0.25), (1.0, "b", 1.0)]
    (tmp_path / "w.json").write_text('[{"time_s": 0, "instance_id": "a", "weight": 1}, {"time_s": 0, "weights": {"a": 2}}]')
    with pytest.raises(ValueError, match="repeat"):
        files.visibility_series(spark, f"{tmp_path}/w.json")


def test_decisions_as_flat_tables(spark, tmp_path):
    rows = [(1, 0.5, {"x": "q1"}, [("x", "q0", 1.0, 10), ("x", "q1", 2.0, 20)], {"x": 0.25}), (2, 0.6, None, None, None)]
    schema = "decision_id int, at double, selection map<string,string>, candidates array<struct<instance_id:string,quality:string,utility:double,cost:int>>, visibility map<string,double>"
    sinks.export_decisions(spark.createDataFrame(rows, schema), f"{tmp_path}/all")
    read = lambda name: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/all/{name}").collect()))
    assert read("decisions") == [(1, 0.5), (2, 0.6)] and read("selections") == [(1, "x", "q1")] and read("visibility") == [(1, "x", 0.25)]
    assert sorted((r.quality, r.place, r.selected) for r in spark.read.parquet(f"{tmp_path}/all/candidates").collect()) == [("q0", 0, False), ("q1", 1, True)]


def test_options_and_similarities(spark):
    given = lambda *words: F.array(*[F.lit(w) for w in words])
    cases = [(given("a", "--n", "5"), "5"), (given("--n=7", "--n", "5"), "7"), (given("--n"), None), (given("--name=1"), None), (given("-k=", "x"), ""), (given("--n", "--n=3"), "--n=3")]
    got = spark.range(1).select(*[scalars.option_value(a, "--n", "-k").alias(f"c{k}") for k, (a, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
    m = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    c, s = math.cos(0.3), math.sin(0.3)
    shapes = [[[2 * c, -2 * s, 0], [2 * s, 2 * c, 0], [0, 0, 2]], [[c, -s, 0], [s, c, 0], [0, 0, -1]], [[1, 0.01, 0], [0, 1, 0], [0, 0, 1]], [[0, 0, 0]] * 3, [[1, 0, 0], [0, 1, 0], [0, 0, 2]]]
    scales = spark.range(1).select(*[scalars.similarity_scale(m(x)).alias(f"c{k}") for k, x in enumerate(shapes)]).first()
    assert math.isclose(scales[0], 2) and list(scales)[1:] == [None] * 4


def test_lookups_and_bytes(spark):
    left, index = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, relational.lookup_one(left, index, ["k"], ["v"]).collect())) == [(1, "a", None), (2, None, "ambiguous"), (3, None, "not found")]
    wanted = spark.createDataFrame([("x", 0, "r", 5), ("x", 0, "r", 5), ("x", 1, "s", 6), ("y", 0, "s", 6), ("y", 1, "t", 7), ("y", 2, "u", 1), ("y", 2, "u", 2)], "o string, c int, k string, b int")
    got = reports.owned_bytes(wanted, wanted.where("k = 't'"), "o", "c", "k", "b").collect()
    assert {(r.o, r.c): (r.missing_bytes, r.reason) for r in got} == {("x", 0): (5, None), ("x", 1): (None, "shared"), ("y", 0): (None, "shared"), ("y", 1): (0, None), ("y", 2): (None, "size differs")}


def test_stalls_durations_and_frames(spark):
    e = spark.createDataFrame([(1, 0.0, 1, "stall"), (1, 1.0, 2, "stall"), (1, 3.0, 3, "go"), (1, 4.0, 4, "frame"), (1, 10.5, 5, "stall"), (1, 11.0, 6, "go"), (1, 12.0, 7, "go"), (1, 15.0, 8, "stall"), (1, 17.0, 9, "go"), (1, 18.0, 10, "stall")], "u int, t double, i int, k string")
    got = temporal.stall_pairs(e, ["u"], "t", "i", "k", "stall", "go", "frame", 10.0, 1.0).collect()
    assert sorted((r.started, r.ended, r.stalled, r.cause) for r in got) == [(0.0, 3.0, 3.0, "startup"), (10.5, 11.0, 0.5, "boundary"), (15.0, 17.0, 2.0, "feature")]
    d = temporal.sample_durations(spark.createDataFrame([(1, 0.0, 1, 5.0), (1, 2.0, 2, None), (1, 3.5, 3, -1.0)], "u int, t double, i int, d double"), ["u"], "t", "i", "d", 4.0).orderBy("i").collect()
    assert [(r.duration, r.duration_from) for r in d] == [(5.0, "explicit"), (1.5, "next"), (0.25, "rate")]
    f = spark.createDataFrame([(1, 4.0, 4.0, 1.0), (1, 1.0, 100.0, 3.0), (1, 0.0, 4.0, 2.0), (1, None, 4.0, 2.0), (1, 1.0, 0.0, 2.0)], "g int, e double, n double, d double")
    r = metrics.frame_summary(f, ["g"], "e", "n", "d").first()
    assert (r.n_rows, r.n_measured, r.n_infinite, r.time_coverage) == (5, 3, 1, 0.6) and math.isclose(r.timed_psnr_db, (0 * 1 + 20 * 3) / 4) and math.isclose(r.psnr_db, 10 * math.log10(108 / 5))


def test_checks(spark):
    rows = [("c", v, p, "m", 30, 0.2) for v in "ab" for p in range(3)]
    faults = lambda more: {(r.rule, r.key) for r in reports.catalog_faults(spark.createDataFrame(more, "c string, v string, p int, m string, r int, l double"), "c", "v", "p", "m", "r", "l").collect()}
    assert faults(rows) == set()
    assert faults(rows[:-1]) == {("mapping", "c:2")} and faults([*rows[:-2], ("c", "b", 2, "m", 30, 0.2)]) == {("places", "c:b"), ("mapping", "c:1")}
    assert faults([*rows[:-1], ("c", "b", 2, "n", 25, 0.21)]) == {("mapping", "c:2"), ("rate", "c:b"), ("whole frames", "c:b:2")}
    d = spark.createDataFrame([(1, 0, 1, 5.0, 6.0), (1, 1, 2, 5.0, 9.0), (1, 2, 3, 1.0, 20.0)], "u int, t int, i int, a double, room double")
    assert [(r.i, r.over) for r in reports.conservation_faults(d, ["u"], "t", "i", "a", "room", 0.5).collect()] == [(2, 1.0)]
    v = spark.createDataFrame([("p", k, x, m, 0.2, s) for k, s, ms in ((1, 10, (0.05, 0.2)), (2, 12, (0.05, 0.1)), (3, 13, (0.1, 0.0)), (4, 5, (0.01,))) for x, m in zip("st", ms)], "g string, v int, x string, m double, w double, s int")
    assert [tuple(r) for r in reports.smallest_that_hold(v, ["g"], "v", "x", "m", "w", "s", 0.1, 0.25, 0.1).collect()] == [("p", 2, 12, 1)]
    t = spark.createDataFrame([("c", "i", 0, [("r", 5), ("s", 6)], 12), ("c", "j", 0, [("r", 5)], 12), ("c", "j", 1, [("z", 99)], 12)], "c string, i string, k int, n array<struct<id:string,bytes:int>>, b int")
    assert [tuple(r) for r in planning.plan_rates(t.where("k = 0").select("c", "i", "k"), t, "c", "i", "k", "n", "b").collect()] == [("c", 11, 12, True)]


def test_picks(spark):
    w = spark.createDataFrame([(k, float(k), float(k % 3)) for k in range(21)], "start int, m double, s double")
    got = {r.kind: r.start for r in reports.window_picks(w, "m", "s").collect()}
    assert got == {"low": 1, "middle": 10, "high": 19}


def test_results_read_again_as_written(spark, tmp_path):
    rows = [(1, 2.5, "a,\n\"b\"", [1, 2], {"k": 1}), (2, None, None, None, None)]
    schema = "i int, x double, t string, a array<int>, m map<string,int>"
    sinks.flat_csv(spark.createDataFrame(rows, schema), f"{tmp_path}/r")
    got = sorted(map(tuple, files.results_csv(spark, f"{tmp_path}/r", schema).collect()))
    assert got == rows
    with pytest.raises(ValueError, match="no column"):
        files.results_csv(spark, f"{tmp_path}/r", "z int")
    with pytest.raises(ValueError, match="do not fit"):
        files.results_csv(spark, f"{tmp_path}/r", "t int").collect()


def test_matrices_are_bounded(spark):
    axis = spark.range(30).selectExpr("id AS a"), spark.range(40).selectExpr("id % 20 AS b")
    done = spark.createDataFrame([(0, 0), (29, 19), (99, 0)], "a long, b long")
    assert runs.work_list(axis, done, ["a", "b"]).count() == 30 * 20 - 2
    with pytest.raises(ValueError, match="600 cells"):
        runs.work_list(axis, done, ["a", "b"], most_cells=599)


def test_arrays_for_every_task_are_bounded(spark, monkeypatch):
    from tidelake.operators import storage

    monkeypatch.setattr(storage, "MOST_STEPS", 3)
    axis = spark.range(4).selectExpr("CAST(id AS DOUBLE) AS v")
    assert relational.bracket(axis.where("v < 3"), axis, "v").count() == 4
    with pytest.raises(Exception, match="more than 3 steps: 4"):
        relational.bracket(axis, axis, "v").collect()


def test_an_objective_of_ones_own(spark):
    from tidelake.operators import selection

    df = spark.createDataFrame([(2.0, 3.0, 4.0, 5.0, 1.0)], "q double, a double, n double, b double, e double")
    selection.register_utility("twice", lambda q, a, n, d0, d: 2 * q)
    try:
        value = lambda m: df.select(selection.utility(m, "q", "a", "n", "b", "e").alias("x")).first().x
        assert value("twice") == 4.0 and value("weighted_sse") == 12.0 and value("share_quality") == 1.5
        with pytest.raises(ValueError, match="already"):
            selection.register_utility("twice", None)
        with pytest.raises(ValueError, match="no method"):
            value("other")
    finally:
        del selection.UTILITIES["twice"]


def test_flat_tables_and_series(spark):
    df = spark.createDataFrame([(1, ((2, [3, 4]), {"k": 5}))], "a int, b struct<c:struct<d:int,e:array<int>>,f:map<string,int>>")
    assert [tuple(r) for r in reports.flattened(df).collect()] == [(1, 2, "[3,4]", '{"k":5}')] and reports.flattened(df).columns == ["a", "b_c_d", "b_c_e", "b_f"]
    with pytest.raises(ValueError, match="one name"):
        reports.flattened(spark.createDataFrame([((1,), 2)], "a struct<b:int>, a_b int"))
    rows = spark.createDataFrame([("g", 1.0, "x", 2.0, 1.0, 0.5), ("g", 0.0, "x", 1.0, 0.0, 0.0)], "g string, t double, i string, w double, s double, v double")
    r = reports.visibility_in_time(rows, ["g"], "t", "i", "w", "s", "v").first()
    assert (r.solo, r.visible, r.occlusion) == (2.0, 1.0, 0.5) and [tuple(x) for x in r.series] == [(0.0, 0.0, 0.0, None), (1.0, 2.0, 1.0, 0.5)]
