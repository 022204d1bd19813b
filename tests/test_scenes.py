"""Layouts, placement, projection and areas against geometry worked out by hand or with numpy."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake import registry
from tidelake.functions import scalars
from tidelake.operators import scenes


def matrix(rows):
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def point(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_layouts(spark):
    df = spark.createDataFrame([("a", k) for k in range(4)], "s string, k int")
    line = [r.x for r in scenes.layout(df, ["s"], "k", "line", 2.0).orderBy("k").collect()]
    assert line == [-3, -1, 1, 3]
    ring = scenes.layout(df, ["s"], "k", "circle", radii=(2.0, 1.0)).orderBy("k").collect()
    assert [(round(r.x, 9), round(r.z, 9)) for r in ring] == [(2, 0), (0, 1), (-2, 0), (0, -1)]
    with pytest.raises(ValueError, match="layout"):
        scenes.layout(df, ["s"], "k", "spiral")


def test_placement_keeps_apart_grows_and_repeats(spark):
    df = spark.createDataFrame([(s, k) for s in ("a", "b") for k in range(12)] + [("a", 0)], "s string, k int")
    args = (df, "s", "k", (-1, -1, -1), (1, 1, 1), 0.9, 7)
    got = {s: np.array([(r.x, r.y, r.z) for r in scenes.placed(*args).where(F.col("s") == s).orderBy("k").collect()]) for s in ("a", "b")}
    for xyz in got.values():
        assert len(xyz) == 12
        apart = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)[np.triu_indices(12, 1)]
        assert apart.min() >= 0.9
    assert not np.allclose(got["a"], got["b"])
    again = np.array([(r.x, r.y, r.z) for r in scenes.placed(*args).where("s = 'a'").orderBy("k").collect()])
    assert np.array_equal(got["a"], again)
    tight = scenes.placed(df, "s", "k", (-0.1, -0.1, -0.1), (0.1, 0.1, 0.1), 0.9, 7, attempts=4).select(F.max(F.abs("x"))).first()[0]
    assert tight > 0.1
    assert scenes.placed(df.limit(0), "s", "k", (0, 0, 0), (1, 1, 1), 0.1, 1).count() == 0


def test_moves_and_pixels(spark):
    turn = scenes.yaw_rows(F.lit(90.0))
    assert np.allclose(one(spark, scenes.moved(point(2, 0, 0), turn, F.lit(3.0), point(1, 0, 0), point(0, 5, 0))), [1, 5, -3])
    at = one(spark, scenes.pixel(point(1, 2, 4), scenes.yaw_rows(F.lit(0.0)), point(0, 0, 0), 100, 641, 481))
    assert (at.u, at.v, at.depth) == (345, 290, 4)
    assert one(spark, scenes.pixel(point(0, 0, -1), scenes.yaw_rows(F.lit(0.0)), point(0, 0, 0), 100, 641, 481)) is None
    assert [round(one(spark, scenes.sine_yaw(F.lit(f), 180, 40.0)), 6) for f in (0, 45, 225, 135)] == [0, 40, 40, -40]


def test_source_local_camera_sees_the_same_pixel(spark):
    rng = np.random.default_rng(3)

    def rotation():
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        return q * np.sign(np.linalg.det(q))

    a, t, b, s, o, p = rotation(), rng.normal(size=3), rotation(), 2.5, rng.normal(size=3), rng.normal(size=3)
    got = one(spark, scenes.source_local(matrix(a), point(*t), matrix(b), F.lit(s), point(*o)))
    world = a @ (s * b @ p + o) + t
    local = np.array(got.turn) @ p + np.array(got.offset)
    assert np.allclose(local * s, world)


def area(spark, low, high, rows=None, clip=True):
    rows = rows or [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, -1.02, -2.02], [0, 0, -1, 0]]  # looks along -z from z = 0, near 1, far about 100
    return one(spark, scenes.projected_area(point(*low), point(*high), matrix(rows), 200, 100, clip))


def test_projected_area(spark):
    # only the front side (z = -2) faces the eye: it reaches from -0.5 to 0.5 of 2 on both axes
    assert math.isclose(area(spark, (-1, -1, -4), (1, 1, -2)), 200 * 100 / 4)
    assert math.isclose(area(spark, (-1, -1, -4), (1, 1, -2), clip=False), 200 * 100 / 4)
    # the front side is larger than the view: cut it fills the view, uncut it counts nothing
    assert math.isclose(area(spark, (-9, -9, -4), (9, 9, -2)), 200 * 100)
    assert area(spark, (-9, -9, -4), (9, 9, -2), clip=False) == 0
    # half of the front side is in view, and the left side (hidden) does not count
    assert math.isclose(area(spark, (0, -1, -4), (4, 1, -2)), 200 * 100 / 4)
    # behind the eye
    assert area(spark, (-1, -1, 2), (1, 1, 4)) == 0
    assert area(spark, (1, 1, -2), (1, 2, -1)) is None
    # seen from the side two sides show: x from 1/2 to 1, their union is the outline
    assert math.isclose(area(spark, (1, -1, -4), (2, 1, -2.5)), 200 * 100 / 4 * ((2 - 1) / 2.5 * (2 / 2.5) + (1 / 2.5 - 1 / 4) * (2 / 2.5 + 2 / 4) / 2))


def test_padded_boxes_and_bounded_growth(spark):
    df = spark.createDataFrame([("a", k, 0.2 + k / 20) for k in range(8)], "s string, k int, h double")
    got = scenes.placed(df, "s", "k", (-1, -1, -1), (1, 1, 1), 0.1, 3, size="h").orderBy("k").collect()
    for i in got:
        for j in got:
            if i.k < j.k:
                assert max(abs(i.x - j.x), abs(i.y - j.y), abs(i.z - j.z)) >= 0.4 + (i.k + j.k) / 20 + 0.1
    with pytest.raises(Exception, match="no place"):
        scenes.placed(df, "s", "k", (0, 0, 0), (0, 0, 0), 0.1, 3, size="h", most_growths=3).collect()


def cut_area(low, high, rows, width, height):
    """By sampling: of every pixel's middle, how many outward sides of the box it hits."""
    m = np.array(rows, float)
    n, total = 400, 0.0
    for d in range(3):
        for end, turn in ((low, -1), (high, 1)):
            a, b = (d + 1) % 3, (d + 2) % 3
            u = (np.arange(n) + 0.5) / n
            p = np.zeros((n, n, 4))
            p[..., d], p[..., 3] = end[d], 1
            p[..., a], p[..., b] = (low[a] + u * (high[a] - low[a]))[:, None], (low[b] + u * (high[b] - low[b]))[None]
            c = p @ m.T
            da, db = m[:, a] * (high[a] - low[a]), m[:, b] * (high[b] - low[b])
            w = c[..., 3]
            seen = (w > 0) & (np.abs(c[..., :3]) <= w[..., None]).all(axis=2)
            ju = [(da[k] * w - c[..., k] * da[3]) / w**2 for k in (0, 1)]
            jv = [(db[k] * w - c[..., k] * db[3]) / w**2 for k in (0, 1)]
            total += max(0.0, turn * float(((ju[0] * jv[1] - ju[1] * jv[0]) * seen).sum()) / n**2)
    return total * width * height / 4


def test_turned_boxes_against_sampling(spark):
    r = np.random.default_rng(8)
    for _ in range(6):
        t = r.uniform(-0.7, 0.7)
        c, s = math.cos(t), math.sin(t)
        rows = [[c, 0, s, 0], [0, 1.5, 0, 0], [1.02 * s, 0, -1.02 * c, -2.02], [s, 0, -c, 0]]
        low = np.array([r.uniform(-2, 1), r.uniform(-2, 1), r.uniform(-7, -2)])
        high = low + r.uniform(0.5, 2.5, 3)
        want = cut_area(low, high, rows, 200, 100)
        assert abs(area(spark, low, high, rows) - want) <= 0.02 * want + 20


def test_many_boxes_take_seconds(spark):
    """As expressions of nested arrays these took minutes; every box counts as it does by itself."""
    rows = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, -1.02, -2.02], [0, 0, -1, 0]]
    df = spark.range(12000).withColumn("x", F.col("id") % 7 - 4.0).withColumn("y", F.col("id") % 5 - 3.0)
    low, high = F.array("x", "y", F.lit(-4.0)), F.array(F.col("x") + 1, F.col("y") + 2, F.lit(-2.5))
    start = time.monotonic()
    got = {(r.x, r.y): (r.n, r.lo, r.hi) for r in df.select("x", "y", scenes.projected_area(low, high, matrix(rows), 200, 100).alias("area")).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("area").alias("lo"), F.max("area").alias("hi")).collect()}
    assert time.monotonic() - start < 60
    assert sum(n for n, _, _ in got.values()) == 12000 and all(lo == hi for _, lo, hi in got.values())
    assert math.isclose(got[0.0, -1.0][1], area(spark, (0, -1, -4), (1, 1, -2.5)))


def test_turned_points_without_arrays(spark):
    r = np.random.default_rng(2)
    rows = [tuple(map(float, x)) for x in r.normal(size=(20, 7))] + [(0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "w double, x double, y double, z double, a double, b double, c double")
    q, p = [F.col(c) for c in "wxyz"], [F.col(c) for c in "abc"]
    for got in df.select(scalars.transformed(scalars.rotation(*q), F.array(*p)).alias("want"), F.array(*scalars.rotated(p, *q)).alias("got")).collect():
        assert got.got == got.want or np.allclose(got.got, got.want)
    plan = registry.queries()["rotated_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
