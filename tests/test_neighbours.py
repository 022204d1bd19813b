import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import neighbours, relational, reports, selection


def gap(a, b, periods):
    d = [abs(x - y) for x, y in zip(a, b)]
    return math.sqrt(sum((min(x, p - x) if p else x) ** 2 for x, p in zip(d, periods)))


@pytest.mark.parametrize(("n", "same"), [(600, True), (600, False), (3, True)])
def test_pruned_neighbours_equal_all_pairs(spark, n, same):
    r = random.Random(n + same)
    rows = [(i, r.uniform(0, 720), r.choice([1.0, 2.0, 4.0]), r.gauss(0, 1)) for i in range(n)]
    asked = [x for x in rows if x[0] % 20 == 0] if same else [(5, -30.0, 3.0, 0.2), (6, 359.0, 1.0, -5.0)]
    axes = {"a": (360.0, 180.0), "b": ("log", 1.0), "c": ("linear", 1e-6)}
    schema = "id int, a double, b double, c double"
    (items, queries), periods = neighbours.on_axes(spark.createDataFrame([*rows, (9999, 1.0, -1.0, 0.0)], schema).where("id < 9999 OR b > 0"), axes, spark.createDataFrame(asked, schema))
    got = neighbours.nearest_pruned(queries, items, "id", "id", "__at", 5, periods, same, sample=64).collect()
    at = {x.id: x["__at"] for x in items.collect()}
    for q in queries.collect():
        want = sorted((round(gap(q["__at"], at[i], periods), 12), i) for i in at if not (same and i == q.id))[:5]
        mine = sorted((x.rank, x.item) for x in got if x.query == q.id)
        assert [i for _, i in mine] == [i for _, i in want]
    if n > 100 and same:
        assert np.mean([x.compared for x in got if x["rank"] == 1]) < 0.4 * n


def test_what_is_compared_hardly_grows(spark):
    """Ten times the items, with many equal ones: about as many are compared, and equal ones are ranked by id."""
    means = []
    for n in (2000, 20000):
        at = [F.rand(k) for k in (1, 2, 3)]
        items = spark.range(n).select("id", F.when(F.col("id") % 10 == 7, F.array(*[F.lit(0.5)] * 3)).otherwise(F.array(*at)).alias("v"))
        asked = spark.createDataFrame([(-k, [k / 40, 0.3, 0.9 - k / 50]) for k in range(1, 40)] + [(-40, [0.5, 0.5, 0.5])], "id long, v array<double>")
        got = neighbours.nearest_pruned(asked, items, "id", "id", "v", 3, [None, None, 1.0], same=False).collect()
        points = {x.id: x.v for x in items.collect()}
        for q in asked.collect():
            want = sorted((round(gap(q.v, v, [None, None, 1.0]), 12), i) for i, v in points.items())[:3]
            assert [x.item for x in sorted((x for x in got if x.query == q.id), key=lambda x: x.rank)] == [i for _, i in want]
        assert sorted(x.item for x in got if x.query == -40) == [7, 17, 27]
        means.append(np.mean([x.compared for x in got if x["rank"] == 1]))
    assert means[1] < 2 * means[0]


def test_no_items(spark):
    none = spark.createDataFrame([], "id int, v array<double>")
    assert neighbours.nearest_pruned(spark.createDataFrame([(1, [0.0])], "id int, v array<double>"), none, "id", "id", "v", 3).count() == 0


def test_whole_grants(spark):
    def grants(demands, room):
        out, active, left = [0] * len(demands), [i for i, d in enumerate(demands) if d], room
        while active and left:
            small = [i for i in active if demands[i] * len(active) <= left]
            if not small:
                for k, i in enumerate(active):
                    out[i] = left // len(active) + (k < left % len(active))
                break
            for i in small:
                out[i], left = demands[i], left - demands[i]
            active = [i for i in active if i not in small]
        return out

    r = random.Random(2)
    groups = [[r.choice([0, 1, 3, 7, 20, 50]) for _ in range(r.randint(1, 12))] for _ in range(40)]
    df = spark.createDataFrame([(g, i, d) for g, ds in enumerate(groups) for i, d in enumerate(ds)], "g int, i int, d int")
    got = {(x.g, x.i): x.granted for x in relational.fair_share(df, ["g"], "i", "d", 37).collect()}
    assert got == {(g, i): v for g, ds in enumerate(groups) for i, v in enumerate(grants(ds, 37))}


def test_aligned_groups_have_the_same_times(spark):
    a = [("x", 1, 10), ("x", 2, 20), ("y", 1, 30), ("z", 1, 40), ("z", 1, 41), ("w", 5, 50)]
    b = [("x", 2, 200), ("x", 1, 100), ("y", 2, 300), ("z", 1, 400), ("w", 5, 500), ("w", 6, 600)]
    schema = "g string, t int, v int"
    got = relational.aligned(spark.createDataFrame(a, schema), spark.createDataFrame(b, "g string, t int, u int"), ["g"], ["t"], "u", "mate").collect()
    assert sorted((r.g, r.t, r.v, r.mate) for r in got) == [("x", 1, 10, 100), ("x", 2, 20, 200)]


def test_masks_of_many_classes(spark):
    """Classes beyond one bucket of bits."""
    n = 33000
    df = spark.range(n).select(F.explode(F.array(F.lit("all"), F.concat(F.lit("one"), F.col("id").cast("string")))).alias("item"), F.col("id").alias("member"))
    got = {r.item: (r.n_classes, r["mask"]) for r in reports.class_masks(df, "item", "member").where("item IN ('all', 'one0', 'one32769')").collect()}
    assert got["all"] == (n, "FF" * (n // 8)) and got["one0"] == (1, "01")
    assert got["one32769"] == (1, "00" * 4096 + "02")


@pytest.mark.parametrize("bins", [5, 64])
def test_bounds_hold_the_optimum(spark, bins):
    r = random.Random(bins)
    rows, want = [], {}
    for case in range(30):
        items = [[(r.randint(0, 30), float(r.randint(-3, 9))) for _ in range(3)] for _ in range(r.randint(1, 4))]
        budget = r.choice([0, 1, 20, 60, 100])
        rows += [(case, i, c, cost, gain, budget) for i, cs in enumerate(items) for c, (cost, gain) in enumerate(cs)]
        all_ = [(sum(items[i][c][1] for i, c in enumerate(p)), sum(items[i][c][0] for i, c in enumerate(p)), sum(-(-items[i][c][0] * bins // budget) if budget else items[i][c][0] > 0 for i, c in enumerate(p)), sum(items[i][c][0] * bins // budget if budget else items[i][c][0] > 0 for i, c in enumerate(p))) for p in itertools.product(range(3), repeat=len(items))]
        room = bins if budget else 0
        exact = max((u for u, c, *_ in all_ if c <= budget), default=None)
        lower = min(((-u, c) for u, c, up, _ in all_ if up <= room), default=None)
        want[case] = exact, lower, max((u for u, _, _, d in all_ if d <= room), default=None)
    got = selection.bounds_within_budget(spark.createDataFrame(rows, "k int, i int, c int, cost int, gain double, budget int"), "k", "i", "c", "cost", "gain", "budget", bins)
    seen = set()
    for x in got.collect():
        exact, lower, upper = want[x.k]
        seen.add(x.status)
        if exact is None:
            assert x.status == "infeasible" and x.utility is x.upper is None
            continue
        assert x.upper == upper and x.utility <= exact <= x.upper and x.gap == x.upper - x.utility
        assert x.status == ("optimal" if lower else "cheapest") and (lower is None or (-x.utility, x.cost) == lower)
    assert "infeasible" in seen and "optimal" in seen


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    """Several blocks of queries and items; equal vectors, nulls, NaN and endless numbers."""
    monkeypatch.setattr(relational, "_ASKED", 20)
    monkeypatch.setattr(relational, "_HELD", 90)
    r = random.Random(9)
    rows = [(i, [r.choice([0.0, 0.25, r.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [None] + [0.0] * 5), (302, [math.nan] + [0.0] * 5), (303, [math.inf] + [0.0] * 5)] + [(304 + i, [0.5] * 6) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    odd = lambda v: v is None or None in v

    def far(a, b):
        if odd(a) or odd(b):
            return (2, 0.0)
        d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
        return (1, 0.0) if math.isnan(d) else (0, d)

    asked = [x for x in rows if x[0] % 4 == 0 or x[0] >= 300]
    got = relational.nearest(df.where("id % 4 = 0 OR id >= 300"), df, "id", "id", "v", 5).collect()
    assert len(got) == 5 * len(asked)
    for q, v in asked:
        want = sorted((*far(v, w), i) for i, w in rows if i != q)[:5]
        mine = sorted((x.rank, x.item) for x in got if x.query == q)
        assert [i for _, i in mine] == [i for *_, i in want]
    assert relational.nearest(df.limit(0), df, "id", "id", "v", 5).count() == 0 == relational.nearest(df, df.limit(0), "id", "id", "v", 5).count()


def test_many_vectors_are_compared_in_seconds(spark):
    """Expressions of arrays took minutes for these 36 million pairs."""
    df = spark.range(60000).select("id", F.array(*[F.randn(k) for k in range(32)]).alias("v"))
    start = time.monotonic()
    assert relational.nearest(df.where("id % 100 = 0"), df, "id", "id", "v", 5).count() == 3000
    assert time.monotonic() - start < 45
