import hashlib

import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalars as f


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_texts(spark):
    lit = F.lit
    assert one(spark, f.clock_text(lit(3725))) == "01:02:05" and one(spark, f.clock_text(lit(360000))) == "100:00:00"
    assert [one(spark, f.iso_duration(lit(x))) for x in (2.0, 10.0, 0.25, 0.0)] == ["PT2S", "PT10S", "PT0.25S", "PT0S"]
    assert one(spark, f.frame_range(lit("3-5, 9,7:7"))) == [3, 4, 5, 9, 7] and one(spark, f.frame_range(lit(None).cast("string"))) is None
    for wrong in ("3-5,x", "5-3", "1,1", "", "1-2,2"):
        with pytest.raises(Exception, match="no frame range"):
            one(spark, f.frame_range(lit(wrong)))
    args = F.array(*[lit(x) for x in ("run", "--n", "5", "--last")])
    assert one(spark, f.option_value(args, "--n")) == "5" and one(spark, f.option_value(args, "--last")) is None and one(spark, f.option_value(args, "--no")) is None
    assert [one(spark, f.available(lit(x).cast("double"), 2)) for x in (None, float("inf"), 1.005)][:2] == ["unavailable", "∞"]


def test_paths_ranges_hashes(spark):
    good, bad = ["a/b.json", "a..b", "x"], ["", "/a", "a/../b", "..", "a//b", "a\\b", "%2e%2e/a", "a/%252e%252e/b", "a/./b"]
    assert all(one(spark, f.safe_relative_path(F.lit(p))) for p in good)
    assert not any(one(spark, f.safe_relative_path(F.lit(p))) for p in bad)
    parse = lambda h: (lambda r: None if r is None else (r["first"], r["last"]))(one(spark, f.byte_range(F.lit(h), F.lit(100))))
    assert [parse(h) for h in ("bytes=0-9", "bytes=90-", "bytes=-5", "bytes=95-200", "bytes=100-", "bytes=-", "bytes=5-2", "x=1-2")] == [(0, 9), (90, 99), (95, 99), (95, 99), None, None, None, None]
    assert one(spark, f.is_sha256(F.lit(hashlib.sha256(b"").hexdigest()))) and not one(spark, f.is_sha256(F.lit("A" * 64)))


def test_numbers(spark):
    assert one(spark, f.angle_difference(F.lit(350.0), F.lit(10.0))) == -20 and one(spark, f.angle_difference(F.lit(10.0), F.lit(350.0))) == 20
    assert one(spark, f.looped_time(F.lit(-1.0), 4.0)) == 3
    assert one(spark, f.transmittance(F.array(F.lit(0.5), F.lit(0.5)))) == 0.25
    assert one(spark, f.mixed_difference(F.lit(1), F.lit(2), F.lit(3), F.lit(5))) == 1
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert one(spark, f.shoelace(square)) == 4
    v = one(spark, f.visibility(F.lit(5.0), F.lit(4.0)))
    assert (v["visible"], v["occlusion"], v["out_of_view"]) == (4, 0, False)
    assert one(spark, f.visibility(F.lit(1.0), F.lit(0.0)))["occlusion"] is None
    assert one(spark, f.dequantised(f.quantised(F.lit(0.3), 0.0, 1.0, 8), 0.0, 1.0, 8)) == 77 / 255
