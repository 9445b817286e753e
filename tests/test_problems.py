"""Orphan references and hierarchies on small cases, cycles and dirty rows."""

import random

from pyspark.sql import functions as F

from corvine.operators import hierarchy, references

EDGE = "edge_key bigint, from_id string, to_id string, type string, created_at string, order_no string"
UNIT = "id string, name string, namespace string, calls array<string>, created_at string, ref string"
NODE = "id string, created_at string"
SYMBOL = "symbol_id string, symbol string"
GONE = "node_id string, name string, namespace string"


def tables(spark, edges=(), units=(), nodes=(), symbols=(), gone=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return make(edges, EDGE), make(units, UNIT), make(nodes, NODE), make(symbols, SYMBOL), make(gone, GONE)


def test_orphans(spark):
    edges = [
        (1, "a", " U1 ", "CALLS", "2024-01-02T00:00:00Z", None), (2, "a", "u1", "CALLS", "2023-01-01 00:00:00", None), (3, "a", "nowhere", "CALLS", None, None),
        (4, "a", "D1", "CALLS", "x", None), (5, "a", None, "CALLS", None, None), (6, "a", "s1", "CALLS", "2020-01-01", None), (7, "a", "u1", "CALLS", None, None),
        (8, "a", "u1", "CALLS", "2024-01-01T01:00:00+02:00", None), (9, "a", "d2", "CALLS", "2024-01-01T00:00:00", None),
    ]
    units = [("u1", "f", "n", ["g", "lib.call", "x.h", None, "old", "f"], "2024-01-01T00:00:00", None), ("u1", "f", "n", ["g"], "2024-02-01T00:00:00", None), ("d2", "z", None, None, None, None)]
    t = tables(spark, edges, units, [("n1", None)], [("S1", "lib.call")], [("d1", "old", "n"), ("d1", "old", "n"), ("d2", "z", "n")])
    got = {tuple(r) for r in references.orphan_references(*t).drop("at").collect()}
    assert got == {
        ("graph_edge", "2", "u1", "late"), ("graph_edge", "3", "nowhere", "missing"), ("graph_edge", "4", "d1", "deleted"), ("graph_edge", "8", "u1", "late"),
        ("code_unit", "u1", "g", "missing"), ("code_unit", "u1", "x.h", "missing"), ("code_unit", "u1", "old", "deleted"),
    }
    report = {(r.ref_table, r.ref_month, r.orphan_kind): r.orphans for r in references.orphan_report(references.orphan_references(*t)).collect()}
    assert report["code_unit", "2024-01", "missing"] == 2


def test_links_to_deleted(spark):
    e = [(1, "a", "D1", "CALLS", "2024-01-02T00:00:00Z", None), (2, "a", "d1", "CALLS", "2024-03-01T00:00:00Z", None), (3, "a", "d1", "CALLS", None, None), (4, "a", "x", "CALLS", None, None)]
    t = tables(spark, e)
    gone = spark.createDataFrame([("d1", "o", "n", "2024-01-01 00:00:00"), ("D1 ", "o", "n", "2024-02-01 00:00:00")], GONE + ", deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    assert {(r.ref_key, r.target_ref, r.after) for r in references.references_to_deleted(*t[:4], gone).collect()} == {("1", "d1", False), ("2", "d1", True), ("3", "d1", None)}


def test_other_parents(spark):
    e = spark.createDataFrame([(1, "a", "c", "CONTAINS", None, None), (2, "C", "b", "part_of", None, None), (3, "a", "d", "CONTAINS", None, None), (4, "a ", "c", "contains", None, None)], EDGE)
    assert [tuple(r) for r in hierarchy.other_parents(e).collect()] == [("c", "b")]


def test_orphans_of_nothing(spark):
    assert references.orphan_references(*tables(spark)).count() == 0


def brute(links):
    parent, nodes, out = dict(links), {x for p in links for x in p}, {}
    for n in nodes:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = (x, len(seen)) if x not in seen else ("cycle", -1 if n in seen[seen.index(x) :] else -2)
    return out


def edges_of(spark, links):
    rows = [(i, p, f" {c.upper()} ", "contains", None, None) if i % 2 else (i, c, p, "PART_OF ", None, None) for i, (c, p) in enumerate(links)]
    return spark.createDataFrame([*rows, *rows[:3], (900, None, "lonely", "CONTAINS", None, None), (901, "a", "b", "CALLS", None, None), (902, "a", "b", None, None, None)], EDGE)


def test_hierarchy_with_cycles(spark):
    rnd = random.Random(5)
    links = [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 120)] + [(f"l{i}", f"l{i + 1}") for i in range(60)]
    links += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("under", "c1"), ("deeper", "under"), ("self", "self"), ("kid", "self")]
    links += [(f"r{i}", f"r{(i + 1) % 23}") for i in range(23)] + [(f"b{i}", f"b{i - 1}" if i else "r3") for i in range(9)]
    want = brute(links) | {"lonely": ("lonely", 0)}
    for every in (1, 2, 4, 1_000_000):  # all nodes, some, and none are splitters
        got = {r.node_id: (r.root_id, r.node_depth) for r in hierarchy.hierarchy(edges_of(spark, links), split_every=every).collect()}
        assert got == want
    paths = hierarchy.hierarchy(edges_of(spark, links), paths=True).collect()
    for r in paths:
        if r.node_depth < 0:
            assert r.path is None
        else:
            assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.node_depth + 1
            assert all(dict(links)[c] == p for p, c in zip(r.path, r.path[1:], strict=False))


def test_hierarchy_of_nothing_and_descendants(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    p = hierarchy.hierarchy(edges_of(spark, [("b", "a"), ("c", "b"), ("d", "b")]), paths=True)
    got = {r.node_id: (r.n_descendants, r.n_children, r.max_height) for r in hierarchy.descendants(p).collect()}
    assert got == {"a": (3, 1, 2), "b": (2, 2, 1), "c": (0, 0, 0), "d": (0, 0, 0), "lonely": (0, 0, 0)}
    assert hierarchy.closure(p).where(F.col("distance") == 2).count() == 2


def test_hot_parent_is_salted(spark, monkeypatch):
    import corvine.common as common

    monkeypatch.setattr(common, "HOT_LEAST", 10)
    monkeypatch.setattr(hierarchy, "HOT_LEAST", 1)
    monkeypatch.setattr(common.hot_keys, "__defaults__", (10,))
    links = [(f"k{i}", "hub") for i in range(200)] + [("hub", "top"), ("x", "k7")]
    got = {r.node_id: (r.root_id, r.node_depth) for r in hierarchy.hierarchy(edges_of(spark, links)).collect()}
    assert got == brute(links) | {"lonely": ("lonely", 0)}


def test_hot_reference_is_salted(spark, monkeypatch):
    import corvine.common as common

    monkeypatch.setattr(common.hot_keys, "__defaults__", (10,))
    edges = [(i, "a", "Hot " if i % 3 else f"n{i}", "USES", "2024-01-01T00:00:00", None) for i in range(300)] + [(900, "a", "gone", "USES", None, None)] * 40
    got = references.orphan_links(*tables(spark, edges, [("hot", "f", "n", None, "2025-01-01", None)], [], [], [("gone", "g", "n")])).collect()
    assert sum(r.orphan_kind == "late" for r in got) == 200 and sum(r.orphan_kind == "missing" for r in got) == 100 and sum(r.orphan_kind == "deleted" for r in got) == 40
