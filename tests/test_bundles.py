"""Scans of bundles and prepared content, hash lists, manifests and event logs: whole ones read, broken ones refused."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidelake.operators import runs
from tidelake.sources import files, sinks


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return hashlib.sha256(path.read_bytes()).hexdigest()


def listing(root):
    names = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and p.name != "SHA256SUMS")
    put(root / "SHA256SUMS", "".join(f"{hashlib.sha256((root / n).read_bytes()).hexdigest()}  {n}\n" for n in names))


def bundle(root):
    objects = []
    for o in ("a", "b"):
        digest = put(root / "manifests" / f"{o}.json", {"object": o})
        put(root / "profiles" / f"{o}.json", {"object_id": o, "manifest_sha256": digest, "rows": [{"quality_id": f"q{k}", "psnr": 30.0 + k, "mse": 1.0 / (k + 1)} for k in range(3)]})
        objects.append({"object_id": o, "profile": f"profiles/{o}.json", "manifest": f"manifests/{o}.json"})
    put(root / "index.json", {"objects": objects})
    listing(root)


def test_hash_lists(spark, tmp_path):
    root = tmp_path / "r"
    put(root / "a", "1"), put(root / "d" / "b", "2"), put(root / "c", "3")
    listing(root)
    assert files.hash_list_faults(spark, f"{root}/SHA256SUMS", str(root)).count() == 0
    put(root / "a", "other"), put(root / "new", "4"), (root / "c").unlink()
    assert {r.name: r.fault for r in files.hash_list_faults(spark, f"{root}/SHA256SUMS", str(root)).collect()} == {"a": "changed", "new": "unlisted", "c": "missing"}
    put(tmp_path / "bad", "xyz  a\n")
    with pytest.raises(ValueError, match="no digest"):
        files.hash_list(spark, f"{tmp_path}/bad")


def test_quality_bundle(spark, tmp_path):
    bundle(tmp_path / "x")
    rows = files.quality_bundle(spark, f"{tmp_path}/x")
    assert sorted((r.object_id, r.quality_id, r.psnr) for r in rows.collect()) == [(o, f"q{k}", 30.0 + k) for o in ("a", "b") for k in range(3)]
    profile = tmp_path / "x" / "profiles" / "b.json"
    put(profile, json.loads(profile.read_text()) | {"manifest_sha256": "0" * 64})
    with pytest.raises(ValueError, match="not as listed"):
        files.quality_bundle(spark, f"{tmp_path}/x")
    listing(tmp_path / "x")
    with pytest.raises(ValueError, match="another object or manifest"):
        files.quality_bundle(spark, f"{tmp_path}/x")


def test_full_coverage(spark, tmp_path):
    q = [{"scene": "s", "quality": k, "psnr": 30.0, "mse": 0.5} for k in range(2)]
    b = [{"scene": "s", "quality": k, "profile_id": f"p{k}"} for k in range(2)]
    lines = lambda name, rows: put(tmp_path / name, "\n".join(map(json.dumps, rows))) and f"{tmp_path}/{name}"
    args = ("scene string, quality int", "psnr double, mse double")
    got = files.full_coverage(spark, lines("q", q), lines("b", b), *args)
    assert sorted((r.quality, r.profile_id) for r in got.collect()) == [(0, "p0"), (1, "p1")]
    for name, quality, bound, message in [("1", q, b[:1], "lacks"), ("2", q[:1], b, "lacks"), ("3", q + q[:1], b, "repeat"), ("4", [q[0], q[1] | {"mse": -1.0}], b, "negative")]:
        with pytest.raises(ValueError, match=message):
            files.full_coverage(spark, lines("q" + name, quality), lines("b" + name, bound), *args)


def test_prepared_content(spark, tmp_path):
    doc = {"object": {"id": "o"}, "representations": [{"id": "r0", "quality": 0, "segments": ["s0", "s1"]}], "package": {"segments": [{"id": "s0", "path": "a.bin", "bytes": 3}, {"id": "s1", "path": "b.bin", "bytes": 2}]}}
    put(tmp_path / "p" / "o" / "manifest.json", doc), put(tmp_path / "p" / "o" / "a.bin", "abc"), put(tmp_path / "p" / "o" / "b.bin", "de")
    rows = files.prepared_content(spark, f"{tmp_path}/p").orderBy("place").collect()
    assert [(r.object_id, r.segment_id, r.bytes, r.path.rsplit("/", 2)[1:]) for r in rows] == [("o", "s0", 3, ["o", "a.bin"]), ("o", "s1", 2, ["o", "b.bin"])]
    put(tmp_path / "p" / "o" / "b.bin", "longer")
    assert files.prepared_content(spark, f"{tmp_path}/p", validate_files=False).count() == 2
    with pytest.raises(ValueError, match="another size"):
        files.prepared_content(spark, f"{tmp_path}/p")
    doc["representations"][0]["segments"].append("s9")
    put(tmp_path / "p" / "o" / "manifest.json", doc)
    with pytest.raises(ValueError, match="index entry"):
        files.prepared_content(spark, f"{tmp_path}/p", validate_files=False)


def test_manifest_written_and_read(spark, tmp_path):
    segments = spark.createDataFrame([("c", 0, 100, 30), ("c", 0, 200, 30), ("c", 1, 10**9, 7)], "content string, rank int, bytes long, ticks long")
    rates = runs.representation_rates(segments, ["content"], "rank", "bytes", "ticks", 30)
    assert [(r.rank, r.segments, r.peak_bps, r.mean_bps, r.required_bps) for r in rates.orderBy("rank").collect()] == [(0, 2, 1600, 1200, 1600), (1, 1, 34285714286, 34285714286, 34285715886)]
    for name in ("m", "n"):
        sinks.manifest_xml(rates, f"{tmp_path}/{name}", "content", "rank", 2.5)
    text = [r.value for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert text == [r.value for r in spark.read.text(f"{tmp_path}/n").collect()] and any("PT2.5S" in t for t in text)
    got = files.manifest_xml(spark, f"{tmp_path}/m").orderBy("_rank").collect()
    assert [(r["_id"], r["_bandwidth"], r["_requiredBandwidth"]) for r in got] == [("c-0", 1600, None), ("c-1", 4294967295, 34285715886)]


def test_event_log_writes_each_event_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"stage": f"s{k}", "at": k}))
        stream = spark.readStream.schema("stage string, at int").json(f"{tmp_path}/in")
        sinks.event_log(stream, f"{tmp_path}/log", f"{tmp_path}/state", available_now=True).awaitTermination(60)
    assert sorted(r.stage for r in spark.read.json(f"{tmp_path}/log").select(F.col("stage")).collect()) == ["s0", "s1"]
