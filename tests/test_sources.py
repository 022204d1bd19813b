import json
import struct

import pytest

from tidelake.sources import files, sinks


def test_traces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_seconds,bandwidth_bps\n0,8e6\n1,4e6\n3,0\n")
    rows = files.bandwidth_trace(spark, f"{tmp_path}/a.csv", duration_s=5.0).orderBy("time_s").collect()
    assert [(r.time_s, r.mbps, r.end_s, r.end_policy) for r in rows] == [(0, 8, 1, "stop"), (1, 4, 3, "stop"), (3, 0, 5, "stop")]
    (tmp_path / "b.json").write_text(json.dumps({"points": [{"time_s": 0, "mbps": 2.5}], "duration_s": 4.0, "loop": True}))
    assert [(r.mbps, r.end_s, r.end_policy) for r in files.bandwidth_trace(spark, f"{tmp_path}/b.json").collect()] == [(2.5, 4.0, "loop")]
    with pytest.raises(ValueError, match="horizon"):
        files.bandwidth_trace(spark, f"{tmp_path}/a.csv")
    (tmp_path / "c.csv").write_text("t,mbps\n0,1\n0,2\n")
    with pytest.raises(ValueError, match="repeats"):
        files.bandwidth_trace(spark, f"{tmp_path}/c.csv", "hold")
    (tmp_path / "d.csv").write_text("t,mbps\n0,-1\n")
    with pytest.raises(ValueError, match="negative"):
        files.bandwidth_trace(spark, f"{tmp_path}/d.csv", "hold")
    (tmp_path / "e.csv").write_text("at_s,mbps\n1,1\n2,2\n")
    with pytest.raises(ValueError, match="starts at zero"):
        files.bandwidth_trace(spark, f"{tmp_path}/e.csv", "hold")
    with pytest.raises(ValueError, match="horizon"):
        files.bandwidth_trace(spark, f"{tmp_path}/a.csv", duration_s=3.0)
    assert tuple(files.constant_trace(spark, 2.5, 4.0).first()) == (0, 2.5, 4.0, "stop")
    with pytest.raises(ValueError, match="rate"):
        files.constant_trace(spark, -1.0)


def test_series_events_profiles(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("time_s,a,b\n0,1,2\n1,3,4\n")
    (tmp_path / "long.csv").write_text("time_s,instance_id,weight\n0,a,1\n0,b,2\n1,a,3\n1,b,4\n")
    read = lambda n: sorted(tuple(r) for r in files.visibility_series(spark, f"{tmp_path}/{n}").collect())
    assert read("wide.csv") == read("long.csv") == [(0, "a", 1), (0, "b", 2), (1, "a", 3), (1, "b", 4)]
    (tmp_path / "e.jsonl").write_text('{"stage":"x","monotonic_s":1.5}\n{"stage":"y","monotonic_s":2}\n')
    assert files.telemetry(spark, f"{tmp_path}/e.jsonl", "stage string, monotonic_s double").count() == 2
    doc = {"instances": [{"instance_id": "i", "gops": [{"gop_id": "g", "qualities": [{"quality_id": "q0", "sse": 9, "resource_ids": ["r"]}, {"quality_id": "q1", "sse": 4, "resource_ids": ["r", "s"]}]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    assert [(r.quality_rank, r.quality_id, r.sse, len(r.resource_ids)) for r in files.profiles(spark, f"{tmp_path}/p.json").orderBy("quality_rank").collect()] == [(0, "q0", 9, 1), (1, "q1", 4, 2)]


def test_artifacts_xml_container(spark, tmp_path):
    for m in ("m1", "m2"):
        d = tmp_path / "runs" / "line" / "N3" / "10s" / m
        d.mkdir(parents=True)
        (d / "completion.json").write_text('{"status": "SUCCESS"}')
    rows = files.run_artifacts(spark, f"{tmp_path}/runs").collect()
    assert sorted((r.scenario, r.objects, r.duration, r.method, r.status) for r in rows) == [("line", "N3", "10s", m, "SUCCESS") for m in ("m1", "m2")]
    (tmp_path / "a.mpd").write_text('<MPD><Representation id="x" bandwidth="5"/><Representation id="y" bandwidth="7"/></MPD>')
    assert sorted(r["_id"] for r in files.manifest_xml(spark, f"{tmp_path}/a.mpd").collect()) == ["x", "y"]
    (tmp_path / "b.mpd").write_text('<!DOCTYPE a [<!ENTITY b "c">]><MPD/>')
    with pytest.raises(ValueError, match="DTD"):
        files.manifest_xml(spark, f"{tmp_path}/b.mpd")
    head = json.dumps({"members": 3}).encode()
    (tmp_path / "c.bin").write_bytes(b"MAGC" + struct.pack("<Q", len(head)) + head + b"body")
    assert files.container_header(spark, f"{tmp_path}/c.bin", b"MAGC", "members int").first()["header"]["members"] == 3
    with pytest.raises(ValueError, match="magic"):
        files.container_header(spark, f"{tmp_path}/c.bin", b"ELSE", "members int")


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 0.5), (2, [], None)], "b int, a array<int>, c double")
    sinks.canonical_json(df, f"{tmp_path}/j")
    lines = sorted(spark.read.text(f"{tmp_path}/j").collect())
    assert [r.value for r in lines] == ['{"a":[1,2],"b":1,"c":0.5}', '{"a":[],"b":2,"c":null}']
    with pytest.raises(Exception, match="not finite"):
        sinks.canonical_json(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/nan")
    sinks.flat_csv(df, f"{tmp_path}/csv")
    assert sorted(r.a for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()) == ["[1,2]", "[]"]
    sinks.export_decisions(spark.createDataFrame([(1, {"x": "q0", "y": "q1"})], "decision_id int, selection map<string,string>"), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d/selections").count() == 2
    built = []
    build = lambda: built.append(1) or df
    assert not sinks.is_complete(spark, f"{tmp_path}/s", "v1")
    for config in ("v1", "v1", "v2"):
        assert sinks.run_stage(spark, f"{tmp_path}/s", config, build).count() == 2
    assert len(built) == 2
    spark.createDataFrame([(3, [1], 0.1)], df.schema).write.mode("overwrite").parquet(f"{tmp_path}/s/data")
    assert not sinks.is_complete(spark, f"{tmp_path}/s", "v2")


def test_journal_and_cache(spark, tmp_path):
    stage = {"status": "done", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:01:00+00:00"}
    (tmp_path / "j.json").write_text(json.dumps({"tasks": {"a": {"stages": {"x": stage, "y": {"status": "running", "started_at": "2024-01-01T00:01:00Z"}}}}}))
    rows = {r.stage: r for r in files.journal(spark, f"{tmp_path}/j.json").collect()}
    assert (rows["x"].finished - rows["x"].started).seconds == 60 and rows["y"].finished is None
    (tmp_path / "k.json").write_text(json.dumps({"tasks": {"a": {"stages": {"x": {"started_at": "2024-01-01T00:00:00Z"}}}}}))
    with pytest.raises(ValueError, match="status"):
        files.journal(spark, f"{tmp_path}/k.json")
    line = {"scene": "s", "frame": 1, "value": 0.5}
    (tmp_path / "c").write_text("\n".join(json.dumps(x) for x in (line, line, line | {"frame": 2})))
    got = files.cached_values(spark, f"{tmp_path}/c", "scene string, frame int")
    assert got.count() == 2 and got.select("key").distinct().count() == 2
    (tmp_path / "d").write_text("\n".join(json.dumps(x) for x in (line, line | {"value": 0.6})))
    with pytest.raises(ValueError, match="measured twice"):
        files.cached_values(spark, f"{tmp_path}/d", "scene string, frame int")
    (tmp_path / "e").write_text(json.dumps({"scene": "s", "value": 1.0}))
    with pytest.raises(ValueError, match="lack"):
        files.cached_values(spark, f"{tmp_path}/e", "scene string, frame int")


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([(1, [1])], "x int, y array<int>")
    b = spark.createDataFrame([(2.5, "t")], "z double, x string")
    sinks.flat_csv_of_all([a, b], f"{tmp_path}/all")
    got = spark.read.csv(f"{tmp_path}/all", header=True)
    assert got.columns == ["x", "y", "z"] and sorted(tuple(r) for r in got.fillna("").collect()) == [("1", "[1]", ""), ("t", "", "2.5")]
    assert sinks.markdown_table(spark.createDataFrame([("a|b", 1.23456, None)], "n string, v double, w int")) == "| n | v | w |\n| --- | --- | --- |\n| a\\|b | 1.235 | NA |\n"
    with pytest.raises(ValueError, match="more than"):
        sinks.markdown_table(spark.range(5), most=4)
