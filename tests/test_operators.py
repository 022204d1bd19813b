"""Operators on small rows against definitions written out plainly, with nulls, ties and empty tables."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidelake.operators import metrics, relational, reports, selection, temporal
from tidelake.operators.storage import ensure_checkpoint_dir, global_row_number


def test_asof_all_ways(spark):
    r = random.Random(1)
    left = [(i, r.randrange(3), r.randrange(20)) for i in range(40)]
    right = [(k, t, k * 100 + t) for k in range(3) for t in r.sample(range(20), 6)]
    a = spark.createDataFrame(left, "id int, k int, t int")
    b = spark.createDataFrame(right, "k int, u int, v int")
    for forward, strict in itertools.product((False, True), repeat=2):
        got = {x.id: x.asof_v for x in temporal.asof_join(a, b, ["k"], "t", "u", ["v"], forward=forward, strict=strict).collect()}
        for i, k, t in left:
            ok = [(u, v) for kk, u, v in right if kk == k and ((u > t if strict else u >= t) if forward else (u < t if strict else u <= t))]
            assert got[i] == ((min if forward else max)(ok)[1] if ok else None), (forward, strict)
    assert temporal.asof_join(a.limit(0), b, ["k"], "t", "u", ["v"]).count() == 0


def test_intervals(spark):
    r = random.Random(2)
    rows = [(k, s, s + r.randrange(-1, 6)) for k in range(4) for s in (r.randrange(30) for _ in range(12))]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    busy = {x.k: x.busy for x in temporal.interval_union(df, ["k"], "s", "e").collect()}
    peak = {x.k: x.peak for x in temporal.peak_concurrency(df, ["k"], "s", "e").collect()}
    for k in range(4):
        cover = [sum(s <= t < e for kk, s, e in rows if kk == k) for t in range(-1, 40)]
        assert busy[k] == sum(c > 0 for c in cover) and peak[k] == max(cover)


def test_range_join_by_bins_equals_nested_loop(spark):
    r = random.Random(3)
    points = spark.createDataFrame([(i, r.random() * 50) for i in range(60)], "id int, t double")
    spans = spark.createDataFrame([(j, a := r.random() * 40, a + r.random() * 15) for j in range(20)], "j int, a double, b double")
    pick = lambda w: sorted((x.id, x.j) for x in temporal.range_join(points, spans, "t", "a", "b", width=w).collect())
    assert pick(4.0) == pick(None)


def test_estimator_statuses(spark):
    rows = [(1, 0.0, 0.0), (1, 1.0, 4.0), (1, 2.0, 2.0), (1, 100.0, 0.0), (2, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "u int, t double, v double")
    got = {(x.u, x.t): (x.estimate_status, x.estimate) for x in temporal.harmonic_estimate(df, ["u"], "t", "v", 2, 10.0, startup=7.0).collect()}
    assert got == {(1, 0.0): ("bootstrap", 7.0), (1, 1.0): ("warming_up", 4.0), (1, 2.0): ("ready", 2 / (1 / 4 + 1 / 2)), (1, 100.0): ("stale", None), (2, 0.0): ("warming_up", 5.0)}


def test_finish_times_against_a_queue(spark):
    r = random.Random(4)
    jobs = [(k, i, float(r.randrange(30)), float(r.randrange(1, 6))) for k in range(3) for i in range(15)]
    got = {(x.k, x.i): x.finish for x in temporal.finish_times(spark.createDataFrame(jobs, "k int, i int, a double, s double"), ["k"], "a", "s", ["a", "i"]).collect()}
    for k in range(3):
        free = 0.0
        for _, i, a, s in sorted((j for j in jobs if j[0] == k), key=lambda j: (j[2], j[1])):
            free = max(free, a) + s
            assert got[k, i] == free


def test_pooled_quality(spark):
    df = spark.createDataFrame([("a", 4.0, 2), ("a", 0.0, 2), ("a", None, 0), ("b", 0.0, 3), ("c", None, None)], "k string, sse double, n int")
    got = {r.k: r for r in metrics.pooled_quality(df, ["k"], "sse", "n").collect()}
    assert got["a"].mse == 1.0 and got["a"].psnr_db == 0 and abs(got["a"].mean_psnr_db + 10 * np.log10(2)) < 1e-9 and got["a"].coverage == 2 / 3
    assert got["b"].is_infinite and got["b"].psnr_db is None
    assert got["c"].n_measured == 0 and got["c"].mse is None and not got["c"].is_infinite


def test_percentiles_ranks_and_fingerprints(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 1.0, 9.0)], "v double").withColumn("k", F.lit(1))
    assert metrics.lower_percentile(df, ["k"], "v", 0.5, "p").first()["p"] == 1.0
    assert sorted(r.x for r in df.select(metrics.average_rank("v").alias("x")).collect()) == [0.5, 0.5, 2.0, 3.0]
    mark = lambda d: metrics.fingerprint(d, ["v"]).first()["fingerprint"]
    assert mark(df) == mark(df.orderBy(F.col("v").desc())) != mark(df.distinct())


def test_pareto_closure_fair_share(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(2), r.randrange(8), r.randrange(8)) for i in range(50)]
    got = {x.i for x in relational.pareto_2d(spark.createDataFrame(rows, "i int, k int, a int, b int"), ["k"], "a", "b").collect()}
    assert got == {i for i, k, a, b in rows if not any(kk == k and aa <= a and bb >= b and (aa < a or bb > b) for _, kk, aa, bb in rows)}
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(20, 5)], "p int, c int")
    done = {(x.ancestor, x.node): x.depth for x in relational.closure(edges, "p", "c").collect()}
    assert done[0, 20] == 20 and done[10, 8] == 14 and (7, 7) not in done
    share = relational.fair_share(spark.createDataFrame([(1, i, float(d)) for i, d in enumerate((1, 4, 10, 30))], "g int, i int, d double"), ["g"], "i", "d", 25.0)
    assert [x.granted for x in share.orderBy("i").collect()] == [1, 4, 10, 10]
    assert {x.n for x in global_row_number(spark.createDataFrame(rows, "i int, k int, a int, b int"), ["a", "b", "i"], "n").collect()} == set(range(1, 51))


def test_knapsack_against_enumeration(spark):
    r = random.Random(6)
    for _ in range(120):
        items, step = r.randint(1, 4), r.choice((1, 2, 3, 7))
        costs = np.array([[float(r.randrange(20)) for _ in range(3)] for _ in range(items)])
        gains = np.array([[float(r.randrange(-3, 6)) for _ in range(3)] for _ in range(items)])
        budget = r.randrange(50)
        status, gain, cost, chosen = selection.solve(costs, gains, budget, step)
        assert selection.solve_by_fronts(costs, gains, step, budget) == (status, gain, cost, chosen)
        fits = [v for v in itertools.product(range(3), repeat=items) if sum(np.ceil(costs[k, c] / step) for k, c in enumerate(v)) <= budget // step]
        if status == "optimal":
            top = max(sum(gains[k, c] for k, c in enumerate(v)) for v in fits)
            assert gain == top and cost <= budget
            assert tuple(chosen) == min(v for v in fits if sum(gains[k, c] for k, c in enumerate(v)) == top)
        elif status == "infeasible":
            assert costs.min(1).sum() > budget
        else:
            assert not fits and costs.min(1).sum() <= budget


def test_knapsack_cap_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, 1.0, 1000), (1, 1, 1, 7, 2.0, 1000)], "case int, item int, choice int, cost int, gain double, room int")
    args = ("case", "item", "choice", "cost", "gain", "room")
    assert selection.select_within_budget(df, *args).first()["selection"] == [1]
    assert selection.select_within_budget(df, *args, max_cells=10).collect() == selection.select_within_budget(df, *args).collect()
    assert selection.select_within_budget(df.limit(0), *args).count() == 0


def test_exact_bytes_against_enumeration():
    r = random.Random(7)
    for _ in range(150):
        items = r.randint(1, 4)
        costs = np.array([[float(r.randrange(15)) for _ in range(3)] for _ in range(items)])
        gains = np.array([[float(r.randrange(-3, 6)) for _ in range(3)] for _ in range(items)])
        budget = r.randrange(40)
        options = [(-sum(gains[k, c] for k, c in enumerate(v)), sum(costs[k, c] for k, c in enumerate(v)), v) for v in itertools.product(range(3), repeat=items)]
        fits = [o for o in options if o[1] <= budget]
        status, gain, cost, chosen = selection.solve_exact_bytes(costs, gains, budget)
        if fits:
            assert status == "optimal" and (-gain, cost, tuple(chosen)) == min(fits)
        else:
            assert status == "infeasible"


def test_shared_resources_against_enumeration(spark):
    r = random.Random(8)
    rows, want = [], {}
    for case in range(25):
        size = {f"r{k}": r.randrange(1, 12) for k in range(6)}
        table = {(i, c): (float(r.randrange(-2, 8)), sorted(r.sample(sorted(size), r.randint(0, 3)))) for i in range(3) for c in range(3)}
        room = r.randrange(30)
        rows += [(case, i, c, u, [{"id": x, "bytes": size[x]} for x in own], room) for (i, c), (u, own) in table.items()]
        best = None
        for v in itertools.product(range(3), repeat=3):
            cost = sum(size[x] for x in {x for i, c in enumerate(v) for x in table[i, c][1]})
            gain = sum(table[i, c][0] for i, c in enumerate(v))
            if cost <= room and (best is None or gain > best):
                best = gain
        want[case] = best
    df = spark.createDataFrame(rows, "case int, item int, choice int, gain double, own array<struct<id:string,bytes:long>>, room int")
    got = {x.case: x for x in selection.select_with_shared_resources(df, "case", "item", "choice", "gain", "own", "room").collect()}
    for case, best in want.items():
        assert got[case].utility == best and (got[case].status == "optimal") == (best is not None)


def test_pairwise_accuracy(spark):
    r = random.Random(8)
    rows = [(k, r.choice([None, *range(7)]), r.choice([None, *range(6)])) for k in ("a", "b", None) for _ in range(40)] + [("one", 1, 1), ("none", None, 2)]
    got = {x.k: (x.pairs, x.accuracy) for x in metrics.pairwise_accuracy(spark.createDataFrame(rows, "k string, p int, a int"), ["k"], "p", "a").collect() if x.k is not None}
    for k in ("a", "b", "one"):
        known = [(p, a) for kk, p, a in rows if kk == k and p is not None and a is not None]
        pairs = [(x, y) for x in known for y in known if x[1] > y[1]]
        right = sum(1 if x[0] > y[0] else 0.5 if x[0] == y[0] else 0 for x, y in pairs)
        assert got[k][0] == len(pairs) and (got[k][1] is None if not pairs else abs(got[k][1] - right / len(pairs)) < 1e-9)
    assert "none" not in got
    assert metrics.pairwise_accuracy(spark.createDataFrame([], "k string, p int, a int"), ["k"], "p", "a").count() == 0


def test_pareto_front_and_boxes(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["a", None]), r.randrange(6), r.randrange(6), r.choice([None, *range(6)])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, s int, x int, y int")
    for blocks in (1, 4):
        got = sorted(x.id for x in relational.pareto_front(df, ["k"], "s", ["x", "y"], blocks).collect())
        full = [x for x in rows if x[4] is not None]
        beats = lambda b, a: b[1] == a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] >= a[4] and b[2:] != a[2:]
        assert got == [a[0] for a in full if not any(beats(b, a) for b in full)]
    assert relational.pareto_front(df.limit(0), ["k"], "s", ["x", "y"]).count() == 0
    for n in (1, 3):
        boxes = [(i, *[v for _ in range(n) for lo in [r.uniform(-5, 5)] for v in (lo, lo + r.choice([0.0, 1.0, 4.0]))]) for i in range(60)]
        names = [(f"l{k}", f"h{k}") for k in range(n)]
        df = spark.createDataFrame(boxes, "id int, " + ", ".join(f"{c} double" for pair in names for c in pair))
        got = sorted((x.a, x.b) for x in relational.box_overlaps(df, "id", names, 1.5).collect())
        over = lambda a, b: all(a[1 + 2 * k] < b[2 + 2 * k] and b[1 + 2 * k] < a[2 + 2 * k] for k in range(n))
        assert got == sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and over(a, b))


def test_looped_integral_and_display(spark):
    steps = spark.createDataFrame([(0.0, 2.0), (3.0, 0.0), (4.5, 1.0)], "t double, r double")
    rate = lambda t: 2.0 if t % 6 < 3 else 0.0 if t % 6 < 4.5 else 1.0
    spans = [(0.0, 6.0), (1.0, 1.0), (5.0, 20.5), (-2.0, 3.0), (4.0, 2.5), (None, 1.0)]
    got = [x.v for x in temporal.looped_integral(steps, "t", "r", 6.0, spark.createDataFrame(spans, "a double, b double").coalesce(1), "a", "b", "v").collect()]
    for (a, b), v in zip(spans, got):
        if a is None:
            assert v is None
            continue
        lo, hi = min(a, b), max(a, b)
        want = sum(rate(lo + (k + 0.5) / 1000) for k in range(round((hi - lo) * 1000))) / 1000
        assert abs(v - (want if b >= a else -want)) < 1e-6
    rows = [("u", 0.0, 0.0, 1), ("u", 2.0, 1.0, 2), ("u", 9.0, 1.0, 3), ("u", 10.0, 3.0, 4), ("v", 1.0, None, 5)]
    shown = temporal.display_records(spark.createDataFrame(rows, "k string, w double, m double, i int"), ["k"], "w", "m", 0.5, "i").collect()
    assert sorted((x.frame, x.wall) for x in shown) == [(0, 0.0), (1, 1.0), (2, 9.0), (3, 9.25), (4, 9.5), (5, 9.75)]


def test_upsert_and_checks(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, 3.0)], "k int, v double, w double")
    b = spark.createDataFrame([(1, 9.0, 8.0), (2, None, None), (4, 4.0, None)], "k int, v double, w double")
    got = sorted((x.k, x.v, x.w, x.origin) for x in relational.upsert(a, b, ["k"], ["v", "w"]).collect())
    assert got == [(1, 1.0, 8.0, "filled"), (2, None, None, "stored"), (3, 3.0, 3.0, "stored"), (4, 4.0, None, "added")]
    wrong = reports.protocol_faults(a, b, ["k"], ["v"]).collect()
    assert sorted((x.k, x.field, x.found, x.wanted) for x in wrong) == [(1, "v", "1.0", "9.0"), (3, None, None, None)]
    failed = reports.first_failed(a, [("v", F.col("v") > 0), ("w", F.col("w") > 5)]).collect()
    assert [x.failed for x in sorted(failed, key=lambda x: x.k)] == ["w", "v", "w"]
    rows = [("c", "r", 0.0, 1), ("c", "q", None, 2), ("c", "q", 1.0, 2), ("d", "r", 0.5, 3)]
    faults = reports.profile_faults(spark.createDataFrame(rows, "c string, q string, e double, id int"), ["c"], "q", "e", "r", ["id"]).collect()
    assert sorted((x.rule, x.key) for x in faults) == [("bad error", "2"), ("missing quality", "d"), ("reference differs", "3"), ("repeated key", "2")]


def test_medians_read_the_middle_only(spark, monkeypatch):
    rows = [(k % 3 if k % 7 else None, float("inf") if k % 11 == 0 else float("nan") if k % 13 == 0 else None if k % 17 == 0 else (k * 7919 % 1000) / 7.0) for k in range(3000)] + [(9, None), (10, 5.0), (10, -1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.median("v").alias("median")).collect()
    plain = lambda rows: sorted(map(repr, rows))
    for accuracy in (10_000, 20, 1):
        assert plain(metrics.medians(df, ["k"], "v", [F.count("*").alias("n")], accuracy).collect()) == plain(want)
    # A sketch that misses the middle costs time, not the result.
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda v, *_: F.array(F.min(v), F.min(v)))
    finite = df.where("v < 1e6")
    got, want = metrics.medians(finite, ["k"], "v").collect(), finite.groupBy("k").agg(F.median("v").alias("median")).collect()
    assert {r.k: round(r.median, 9) for r in got} == {r.k: round(r.median, 9) for r in want}


def test_package_faults_sort_once(spark):
    rows = [(1, 1), (1, 2), (1, 2), (1, 2), (2, 1), (2, 3), (3, None), (3, None), (4, 1), (4, 2), (5, 2), (None, 1), (None, 1), (6, 1), (6, None)]
    members, sources = spark.createDataFrame(rows, "s long, p int"), spark.createDataFrame([(1,), (2,), (4,), (4,), (6,), (7,), (7,), (None,)], "s long")
    out = reports.package_faults(members, sources, "s", "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan and "Join" not in plan
    want = [("repeated key", k) for k in ("1:2", "3", "1")] + [("no source", k) for k in ("3", "5", "")] + [("not covered", k) for k in ("7", "7", "")] + [("places", k) for k in ("1", "2", "3", "5", "", "6")]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
