import duckdb

from tidelake import registry
from tidelake.operators import graphs
from tidelake.operators import packages as p
from tidelake.plans import dependencies

FRAMES = [(0, 1, 100, 0.0), (0, 2, 101, 0.1), (0, 3, 102, 0.2), (0, 4, 103, 0.3)]
PAYLOADS = [(0, f"{q}{k}", "m", q, 100 + k, k // 2, k / 10, 10, f"d{q}{k}", k % 2 == 0) for q in "ab" for k in range(4)]
NEEDS = [(0, f"b{k}", f"a{k}") for k in range(4)]
SEGMENTS = [(0, f"{q}-{e}", "m", q, e, 5, 25, 100 + 2 * e, 101 + 2 * e) for q in "ab" for e in (0, 1)]
MEMBERS = [(0, f"{q}-{k // 2}", k % 2, f"{q}{k}", 5 + 10 * (k % 2), 10, f"d{q}{k}") for q in "ab" for k in range(4)]
SCHEMAS = ["package int, place int, frame int, moment double", "package int, id string, mode string, quality string, frame int, epoch int, moment double, bytes int, digest string, refresh boolean", "package int, id string, parent string", "package int, segment string, mode string, quality string, epoch int, header int, bytes int, first_frame int, last_frame int", "package int, segment string, place int, id string, offset int, length int, digest string"]
#: rule: table, row, place of a value, value; or a row to add or leave out.
PLANTED = {
    "frame repeats": (0, 1, 2, 100), "frame order": (0, 1, 3, 0.0), "payload repeats": (1, "add", PAYLOADS[0]), "unknown frame": (1, 0, 4, 999), "sample missing": (1, "drop", 3), "wrong epoch": (1, 1, 5, 1),
    "timestamp differs": (1, 2, 6, 9.0), "no refresh": (1, 0, 9, False), "missing dependency": (2, 0, 2, "zz"), "dependency of another frame": (2, 0, 2, "a1"), "dependency cycle": (2, "add", (0, "a0", "b0")),
    "segment repeats": (3, "add", SEGMENTS[0]), "unknown segment": (4, 0, 1, "q"), "packaged twice": (4, "add", (0, "a-0", 2, "a1", 25, 10, "da1")), "unpackaged payload": (4, "drop", 7), "unknown member": (4, 0, 3, "zz"),
    "member differs": (4, 0, 6, "other"), "offset gap": (4, 1, 4, 16), "offset overlap": (4, 1, 4, 14), "segment length": (3, 0, 6, 26), "segment crosses": (3, 0, 4, 1), "frame range": (3, 0, 7, 101),
}


def faults(spark, tables):
    return {(r.rule, r.key) for r in p.package_index_faults(*[spark.createDataFrame(rows, s) for rows, s in zip(tables, SCHEMAS)], epoch_frames=2).collect()}


def test_a_sound_package_has_no_faults(spark):
    assert faults(spark, [FRAMES, PAYLOADS, NEEDS, SEGMENTS, MEMBERS]) == set()
    assert set(PLANTED) == set(p.RULES)


def test_each_planted_fault_is_told(spark):
    """Each fault in a package of its own, several at once."""
    rules = sorted(PLANTED)
    tables = [[], [], [], [], []]
    for n, rule in enumerate(rules):
        at, what, *how = PLANTED[rule]
        for k, rows in enumerate((FRAMES, PAYLOADS, NEEDS, SEGMENTS, MEMBERS)):
            rows = [list(r) for r in rows]
            if k == at and what == "add":
                rows.append(list(how[0]))
            elif k == at and what == "drop":
                del rows[how[0]]
            elif k == at:
                rows[what][how[0]] = how[1]
            tables[k] += [(n, *r[1:]) for r in rows]
    got = p.package_index_faults(*[spark.createDataFrame(rows, s) for rows, s in zip(tables, SCHEMAS)], epoch_frames=2)
    told = {(r.package, r.rule) for r in got.collect()}
    assert {(n, rule) for n, rule in enumerate(rules)} <= told


def test_moments_are_rounded_as_in_sql(spark, tmp_path):
    """Prices whose whole parts rise while the rounded ones do not, and the other way round."""
    prices = [(1, 7, 100.6), (2, 7, 101.4), (3, 8, 50.4), (4, 8, 50.6), (5, 9, 10.5), (6, 9, 11.5)]
    lines = [(o, 1, 5, 6, 10.0 * o, 3.5, 0.04, 0.05, "A", "F") for o, _, _ in prices]
    spark.createDataFrame(prices, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {tuple(map(str, r)) for r in duck.sql(registry.oracle_sql()["package_index"]).fetchall()}
    assert ("7", "frame order", "2") in want
    assert {tuple(map(str, r)) for r in registry.queries()["package_index"](spark, str(tmp_path)).collect()} == want


def test_rules_shuffle_nothing_once_tables_are_dealt(spark):
    """All rules read one table dealt by package; only the few payloads on cycles are shuffled to be told once."""
    out = p.package_index_faults(*[spark.createDataFrame(rows, s) for rows, s in zip([FRAMES, PAYLOADS, NEEDS, SEGMENTS, MEMBERS], SCHEMAS)], epoch_frames=2, buckets=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") >= 4
    assert out.collect() == []


def test_cycles_are_found_within_their_bounds(spark):
    """Against all needs at once: payloads on cycles and between two, up and down, beside long chains, lacking parents and payloads that are none."""
    edges = {
        0: [(1, 2), (2, 1), (1, 50), (50, 100), (100, 101), (101, 100), (3, 1), (50, 7)],
        1: [(100, 101), (101, 100), (100, 50), (50, 1), (1, 2), (2, 1), (200, 100)],
        2: [(n, n - 1) for n in range(2, 6)] + [(1, 1), (91, 999), (91, 92), (92, 91), (999, 3)],
        3: [(n, n - 1) for n in range(2, 6)],
        4: [(5, 9), (9, 7), (7, 5), (8, 6), (6, 777), (4, 5)],
    }
    payloads = [(k, n, "m", 1, n, 0, 0.0, 1, "d", True) for k in edges for n in range(1, 201) if n != 8]
    needs = [(k, c, up) for k in edges for c, up in edges[k]]
    tables = [[], payloads, needs, [], []]
    types = [s.replace("id string", "id int").replace("parent string", "parent int").replace("quality string", "quality int") for s in SCHEMAS]
    got = p.package_index_faults(*[spark.createDataFrame(rows, s) for rows, s in zip(tables, types)], epoch_frames=2).where("rule IN ('dependency cycle', 'missing dependency')").collect()
    ids = spark.createDataFrame([(f"{k}:{n}",) for k, n, *_ in payloads], "node string")
    links = spark.createDataFrame([(f"{k}:{c}", f"{k}:{up}") for k, c, up in needs], "c string, p string")
    layers = graphs.decode_layers(ids, links, "node", "c", "p").where("fault IN ('cycle', 'missing parent')").collect()
    want = sorted((*r.node.split(":"), {"cycle": "dependency cycle", "missing parent": "missing dependency"}[r.fault]) for r in layers)
    assert sorted((str(r.package), r.key, r.rule) for r in got) == want
    assert ("1", "50", "dependency cycle") in want and ("2", "91", "missing dependency") in want


def test_buckets_follow_the_lines():
    """A small table is not dealt into many files because the session has many partitions; a large one has buckets enough."""
    assert [dependencies.package_buckets(n, 211) for n in (0, 60_000, 600_000)] == [1, 1, 10]
    assert [dependencies.package_buckets(n, 12) for n in (600_000, 36_000_000)] == [10, 69] and dependencies.package_buckets(36_000_000, 97) == 97
