"""Labels, plans, gaps and replays against enumeration and by hand."""

import itertools

import numpy as np
import pytest

from tidelake.operators import planning as p


def test_labels_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, k = rng.integers(1, 6), rng.integers(1, 5)
        costs, gains = rng.integers(1, 20, (n, k)).astype(float), rng.integers(-5, 30, (n, k)).astype(float)
        holes = rng.random((n, k)) < 0.2
        holes[:, 0] = False
        costs[holes], gains[holes] = np.nan, np.nan
        budget = int(rng.integers(1, 20 * n))
        fits = [(sum(gains[i, c] for i, c in enumerate(x)), -sum(costs[i, c] for i, c in enumerate(x))) for x in itertools.product(range(k), repeat=n)]
        fits = [f for f in fits if not np.isnan(f[0]) and -f[1] <= budget]
        status, gain, spent, chosen = p.solve_by_labels(costs, gains, budget, 10_000)
        assert status == ("optimal" if fits else "infeasible")
        if fits:
            assert gain == max(fits)[0] and spent == sum(costs[i, c] for i, c in enumerate(chosen)) <= budget
            cut = p.solve_by_labels(costs, gains, budget, 1)
            assert cut[0] in ("optimal", "incomplete") and cut[1] <= gain and cut[2] <= budget


def test_incomplete_cases_are_finished(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, c, int(rng.integers(1, 99)) if c else 1, float(rng.integers(1, 99)) if c else 0.0, 200) for i in range(8) for c in range(4)]
    df = spark.createDataFrame(rows, "case string, item int, choice int, cost long, utility double, budget long")
    args = ("case", "item", "choice", "cost", "utility", "budget")
    whole, cut, done = (p.select_by_labels(df, *args, **k).first() for k in ({}, {"max_labels": 1, "finish": False}, {"max_labels": 1}))
    assert cut.status == "incomplete" and cut.cost <= 200 and done.status == whole.status == "optimal" and done.utility == whole.utility >= cut.utility


def test_plan_locks_clones_and_fallback(spark):
    def item(case, name, locked, budget, w=1.0, base="b"):
        return [(case, name, c, w, float(q), [(base, 10), *([(f"{base}{c}", extra)] if extra else [])], locked, budget) for c, (q, extra) in enumerate([(1, 0), (5, 40), (9, 100)])]

    rows = item("one", "x", None, 50) + item("one", "y", None, 50)  # clones: 10 + 40 pays for both
    rows += item("low", "x", None, 9) + item("low", "y", 2, 9)
    rows += item("lock", "x", 2, 110) + item("lock", "y", None, 110, base="c")
    rows += item("lock2", "x", 2, 160) + item("lock2", "y", None, 160, base="c")
    df = spark.createDataFrame(rows, "case string, item string, choice int, w double, q double, res array<struct<id:string,bytes:long>>, locked int, budget long")
    got = {(r.case, r.item): (r.choice, r.status) for r in p.plan(df, "case", "item", "choice", "w", "q", "res", "locked", "budget").collect()}
    assert got[("one", "x")] == got[("one", "y")] == (1, "planned")
    assert got[("low", "x")] == (0, "fallback") and got[("low", "y")] == (2, "fallback")
    assert got[("lock", "x")] == (2, "fallback") and got[("lock", "y")] == (0, "fallback")  # 110 paid for x, 10 for y
    assert got[("lock2", "x")] == (2, "planned") and got[("lock2", "y")] == (1, "planned")


def test_gaps_and_replays(spark):
    d = spark.createDataFrame([("a", 3.0), ("b", 0.5)], "k string, e double")
    o = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "k string, e double")
    assert sorted((r.k, r.gap, r.relative_gap) for r in p.oracle_gap(d, o, ["k"], "e").collect()) == [("a", 1.0, 0.5), ("b", 0.5, None)]
    with pytest.raises(Exception, match="beats"):
        p.oracle_gap(o, d, ["k"], "e").collect()
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    assert {r.k: r.verdict for r in p.replayed(old, new, ["k"], ["v"]).collect()} == {1: "same", 2: "changed", 3: "lost", 4: "new"}
    with pytest.raises(ValueError, match="policy"):
        p.policy_values("none", "q", "b", "o", "c", "i", "k")
