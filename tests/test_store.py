"""Tables derived once, upserts that swap whole partitions, and the operators added beside them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvine import common, model
from corvine.functions import text
from corvine.operators import context, flow, graph, retrieve
from corvine.sources import store


def test_derived_once_and_anew_for_new_data(spark, tmp_path):
    d, calls = str(tmp_path), []
    spark.createDataFrame([(1, "a"), (2, None)], "v int, k string").write.parquet(f"{d}/t.parquet")

    def build():
        calls.append(1)
        return spark.read.parquet(f"{d}/t.parquet")

    get = lambda: store.derived(spark, d, "x", ["t"], build, ["k"], ["v"])
    assert {(r.v, r.k) for r in get().collect()} == {(1, "a"), (2, None)} and get().where("k = 'a'").count() == 1 and len(calls) == 1
    spark.createDataFrame([(3, "b")], "v int, k string").write.mode("append").parquet(f"{d}/t.parquet")
    assert get().count() == 3 and len(calls) == 2


def test_last_load_wins(spark):
    t = lambda x: datetime.datetime(2024, 1, x)
    rows = [("a", "new", 1, t(2)), ("a", "old", 9, t(1)), ("b", "x", None, None), ("b", "y", None, None), ("c", None, 1, t(1)), ("c", "z", 9, None)]
    got = model.last_load(spark.createDataFrame(rows, "id string, name string, line int, at timestamp"), ["id"], ["name", "line"], F.col("at"))
    assert {tuple(r) for r in got.collect()} == {("a", "new", 1), ("b", "y", None), ("c", None, 1)}
    assert model.last_load(spark.createDataFrame(rows, "id string, name string, line int, at timestamp").limit(0), ["id"], ["name"], F.col("at")).count() == 0


def test_counters_swap_and_scroll(spark, tmp_path):
    t, schema = str(tmp_path / "t"), "namespace string, id string, v int"
    assert store.write(spark.createDataFrame([("n", "a", 1), ("m/x", "a", 1)], schema), t) == {"created": 2, "set": 0, "deleted": 0}
    assert store.upsert(spark, t, spark.createDataFrame([("n", "a", 2), ("n", "b", 3), (None, "c", 4)], schema), ["namespace", "id"]) == {"created": 2, "set": 1, "deleted": 0}
    assert store.delete_namespace(spark, t, "m/x") == {"created": 0, "set": 0, "deleted": 1} and not list(tmp_path.glob("t.*"))
    assert {(r.namespace, r.id, r.v) for r in spark.read.parquet(t).collect()} == {("n", "a", 2), ("n", "b", 3), (None, "c", 4)}
    assert [r.id for r in store.scroll(spark.read.parquet(t), "id").collect()] == ["a"] and [r.id for r in store.scroll(spark.read.parquet(t), "id", "a", 5).collect()] == ["b", "c"]


def test_no_local_checkpoints_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Fake)


def test_hot_half_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common.hot_keys, "__defaults__", (10,))
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(2000)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", "H"), ("k2", "two")], "k string, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = common.salted_lookup(left, right, "k")
        salts = common.hot_keys(left, "k", 10).collect()
        rows = {(r.k, r.i): r.v for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r.k for r in salts] == ["hot"] and salts[0].n_salts >= 64
    assert len(rows) == 2001 and all(rows["hot", i] == "H" for i in range(1, 2000, 2)) and rows["k2", 2] == "two" and rows["k4", 4] is None and rows[None, -1] is None


NODE = "id string, name string, label string, namespace string, file_path string, language string, complexity int"
EDGE = "src string, dst string, type string, call_count int, is_recursive boolean, import_type string, dependency_type string, order_no int"


def small_graph(spark):
    n = [("f", "open", "Function", "n", "a.py"), ("g", "get", "Function", "n", "a.py"), ("h", "hash", "Function", "m", "b.py"), ("c", "C", "Class", "n", "a.py"), ("p", "P", "Class", "n", "a.py"), ("q", "Q", "Class", "n", "a.py"), ("s", "lib", "Symbol", None, None)]
    e = [("f", "g", "CALLS"), ("g", "h", "CALLS"), ("h", "s", "CALLS"), ("f", "s", "CALLS"), ("c", "f", "CONTAINS"), ("c", "p", "INHERITS_FROM"), ("p", "q", "INHERITS_FROM"), ("q", "c", "INHERITS_FROM")]
    return spark.createDataFrame([(*x, None, None) for x in n], NODE), spark.createDataFrame([(*x, None, None, None, None, None) for x in e], EDGE)


def test_graph_operators(spark):
    n, e = small_graph(spark)
    assert {(r.class_id, r.ancestor_id, r.depth) for r in graph.class_hierarchy(n, e).collect()} == {(a, b, k) for a, order in (("c", "pqc"), ("p", "qcp"), ("q", "cpq")) for k, b in enumerate(order, 1)}
    long = spark.createDataFrame([(f"k{i:02}", f"k{i + 1:02}", "INHERITS_FROM") for i in range(12)], "src string, dst string, type string")
    assert graph.class_hierarchy(n, long).where("class_id = 'k00'").agg(F.max("depth")).first()[0] == 12
    t = graph.entry_to_target(n, e, spark.createDataFrame([("f",)], "start string"), n.where("label = 'Symbol'").select("id"), 3, 5).orderBy("place").collect()
    assert [(r.depth, r.names) for r in t] == [(1, "open -> lib"), (3, "open -> get -> hash -> lib")]
    assert [tuple(r) for r in graph.cross_namespace_edges(n, e).collect()] == [("CALLS", "n", "m", 1)]
    made = graph.create_nodes(n, spark.createDataFrame([("f",), ("z",), ("y",), ("y",)], "id string"))
    assert sorted((r.id, r.created) for r in made.collect()) == [("f", False), ("y", False), ("y", False), ("z", True)]
    gone = spark.createDataFrame([("f",), ("f",), ("nowhere",)], "id string")
    left_n, left_e = graph.delete_nodes(n, e, gone)
    assert left_n.count() == 6 and left_e.count() == 5 and graph.delete_nodes(n, e, gone, detach=False)[0].count() == 7
    assert graph.get_node(n, F.lit("c"), "Class", "n").count() == 1 and graph.get_node(n, F.lit("c"), "Function").count() == 0
    assert {tuple(r) for r in retrieve.expand_hits(n, e, n.where("id = 'f'").select("id")).collect()} == {("f", "callee", "g", "get"), ("f", "callee", "s", "lib"), ("f", "parent", "c", "C")}


def test_calls_in_files(spark):
    u = spark.createDataFrame([("a1", "run", "Function", "n", "a", 1, ["go", "x.go", None]), ("a2", "go", "Function", "n", "a", 5, []), ("a3", "go", "Method", "n", "a", 9, ["run"]), ("b1", "go", "Function", "n", "b", 1, ["run", "s.go"])], "id string, name string, type string, namespace string, file_path string, line_start int, calls array<string>")
    assert {(r.src, r.dst) for r in graph.resolve_calls_in_file(u).collect()} == {("a1", "a3"), ("a3", "a1")}
    e = spark.createDataFrame([("a1", "a2", "CALLS")], "src string, dst string, type string")
    assert tuple(graph.rebuild_counts(u, e).first()) == ("n", 5, 1, 3, 1, 0.8)


def test_analysis_of_flows(spark):
    steps = spark.createDataFrame([("F", 1, 1.0, []), ("F", 2, 3.0, [1]), ("F", 3, 2.0, [1]), ("F", 4, 1.0, [2, 3])], "flow_id string, step int, minutes double, depends_on array<int>")
    pairs = spark.createDataFrame([("F", 2, 3), ("F", 3, 2)], "flow_id string, step int, other int")
    flows, marked = flow.analyze(steps, pairs)
    r = flows.first()
    assert (r.total_steps, r.parallel_groups, r.critical_time, r.critical_path) == (4, 1, 5.0, "1,2,4") and {(x.step, x.is_critical_path) for x in marked.collect()} == {(1, True), (2, True), (3, False), (4, True)}
    assert r.advice.split("\n") == ["Found 1 parallelization opportunities that could provide 1.40x speedup", "Parallel Group 1: Step 2, Step 3 can run concurrently", "Critical path contains 3 steps: Step 1, Step 2, Step 4", "Focus optimization efforts on critical path steps for maximum impact"]
    late = flow.recommendations(flow.speedup(steps, flow.all_groups(steps, pairs)), flow.all_groups(steps, pairs), flow.critical_paths(steps), spark.createDataFrame([("F", 2)], "flow_id string, n_async int"))
    assert late.first().advice.split("\n")[-1] == "2 async steps could benefit from concurrent execution"
    assert flow.analyze(steps.limit(0), pairs.limit(0))[0].count() == 0


def test_large_flows_are_solved_by_joins(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(f, i, float(rnd.randrange(0, 5)), sorted({rnd.randrange(1, i) for _ in range(rnd.randrange(3))}) if i > 1 else [99]) for f in "ABC" for i in range(1, 9)]
    rows += [("loop", 1, 1.0, [2]), ("loop", 2, 1.0, [1]), ("loop", 3, 1.0, []), ("one", 1, 2.0, []), ("part", 1, 2.0, []), ("part", 2, 1.0, [1, 3]), ("part", 3, 1.0, [3])]
    df = spark.createDataFrame(rows, "flow_id string, step int, minutes double, depends_on array<int>")
    want = {tuple(r) for r in flow.critical_paths(df).collect()}
    monkeypatch.setattr(flow, "LARGE_FLOW", 2)
    assert {tuple(r) for r in flow.critical_paths(df).collect()} == want and ("loop", None, "") in want and len(want) == 6


def test_formats(spark):
    rows = spark.createDataFrame([("2", "b", "x"), ("1", "a", "y,z")], "id string, name string, others string")
    r = context.format_parallel(rows).first()
    assert r.content == "# Parallel Execution Opportunities\n\n**a**\n  - Can run in parallel with: y, z\n\n**b**\n  - Can run in parallel with: x\n" and r.relevance_score == 0.9
    assert context.format_parallel(rows.limit(0)).count() == 0
    d = spark.createDataFrame([("b", ""), ("a", "x,y")], "name string, dependencies string")
    assert context.format_dependencies(d).first().content == "# Dependency Analysis\n\n**a**\n  Depends on:\n  - x\n  - y\n\n**b**\n  No dependencies\n"
    f = context.format_each(spark.createDataFrame([("1", "flow")], "id string, name string"), "find_flow", context.format_flow(), "id").first()
    assert (f.content, f.relevance_score, f.citation) == ("# Execution Flow\n\n**Description:** flow\n", 0.8, "[G1] Execution Flow")


def test_subsections(spark):
    body = "x" * 3000 + "\n### One\nfirst\n### Two"
    s = spark.createDataFrame([(1, 0, "A", body), (1, 1, "B", "short\n### not cut")], "doc_id int, section_no int, heading string, body string")
    assert [(r.section_no, r.part_no, r.part, r.body[:9]) for r in text.subsections(s).orderBy("section_no", "part_no").collect()] == [(0, 0, "main", "x" * 9), (0, 1, "One", "first"), (0, 2, "Two", ""), (1, 0, None, "short\n###")]
