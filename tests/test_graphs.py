import random

import pytest

from tidelake.operators import graphs


def brute(nodes, edges):
    """Layers and faults by the definition."""
    nodes = set(nodes)
    needs = {n: {p for c, p in edges if c == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(needs[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += needs.get(x, ())
        reach[n] = seen
    turning = {n for n in nodes if n in reach[n]}
    out = {}

    def layer(n):
        return 1 + max(map(layer, needs[n])) if needs[n] else 0

    for n in nodes:
        everything = reach[n] | {n}
        if needs[n] - nodes:
            out[n] = (None, "missing parent")
        elif everything & turning and any(n in reach[t] or n == t for t in turning):
            out[n] = (None, "cycle")
        elif everything & turning or any(needs.get(x, set()) - nodes for x in everything if x in nodes) or everything - nodes:
            out[n] = (None, "blocked")
        else:
            out[n] = (layer(n), None)
    return out


def found(spark, nodes, edges):
    got = graphs.decode_layers(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "c long, p long"), "id", "c", "p")
    assert got.columns == ["id", "layer", "fault"]
    rows = [(r.id, r.layer, r.fault) for r in got.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {n: (k, f) for n, k, f in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_of_many_parents(spark, seed):
    r = random.Random(seed)
    nodes = list(range(60))
    edges = [(c, c - r.randint(1, 9)) for c in nodes for _ in range(r.randint(0, 2)) if c > 8] + [(5, 1), (5, 2), (200, 3)]
    edges += [(20, 25), (25, 20)] * (seed == 1) + [(50, 50), (58, 999)] * (seed == 2)
    assert found(spark, nodes, edges) == brute(nodes, edges)


@pytest.mark.parametrize("seed", [0])
def test_layers_of_single_parents(spark, seed):
    r = random.Random(10 + seed)
    nodes = list(range(80))
    edges = [(c, r.choice([c - 1, r.randint(0, 79)])) for c in nodes if r.random() < 0.9 and c]
    assert found(spark, nodes, edges) == brute(nodes, edges)


def test_long_chain_with_cycle_and_orphan(spark):
    nodes = list(range(200)) + list(range(2000, 2007)) + [3000, 3001, 3002]
    edges = [(k, k - 1) for k in range(1, 200)] + [(2000 + k, 2000 + (k + 1) % 5) for k in range(5)] + [(2005, 2000), (2006, 2005), (3000, 4000), (3001, 3000), (3002, 3001)]
    got = found(spark, nodes, edges)
    assert all(got[k] == (k, None) for k in range(200))
    assert [got[2000 + k][1] for k in range(7)] == ["cycle"] * 5 + ["blocked"] * 2
    assert [got[3000 + k][1] for k in range(3)] == ["missing parent", "blocked", "blocked"]


def test_chain_sums(spark):
    rows = [(k, k - 1 if k else None, k) for k in range(100)] + [(500, 501, 1), (501, 500, 1), (600, 999, 5)]
    got = {r.id: (r.layer, r.fault, r.total) for r in graphs.chain_sums(spark.createDataFrame(rows, "id long, up long, bytes long"), "id", "up", "bytes").collect()}
    assert all(got[k] == (k, None, k * (k + 1) // 2) for k in range(100))
    assert got[500] == got[501] == (None, "cycle", None) and got[600] == (None, "missing parent", None)


def test_no_nodes(spark):
    assert found(spark, [], []) == {}


def test_chains_send_no_table_through_the_driver(spark, monkeypatch):
    """Each round's table joins by shuffles, however small it is."""
    plans, store = [], graphs.Scratch.store

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df)

    monkeypatch.setattr(graphs.Scratch, "store", noted)
    df = spark.createDataFrame([(k, k - 1 if k else None, 1) for k in range(40)], "n int, p int, v int")
    assert {(r.n, r.layer, r.total) for r in graphs.chain_sums(df, "n", "p", "v").collect()} == {(k, k, k + 1) for k in range(40)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
