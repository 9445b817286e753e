"""Golden cases of the operators, and their behaviour on nulls, ties and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from corvine import model
from corvine.common import iso_ts
from corvine.functions import text
from corvine.operators import context, detect, expand, flow, graph, intent, vector
from corvine.sources import files, parse, store
from corvine.streaming import ingest

SAMPLE = '''import json
from typing import List


def process_data(d: List[int]) -> int:
    """Runs all."""
    x = clean_data(d)
    validate_data(x)
    return transform_data(x)


def clean_data(d):
    return d


def validate_data(d):
    return bool(d)


def transform_data(d):
    return d


class DataProcessor(Base):
    def __init__(self):
        self.x = 1

    def run(self):
        return process_data(self.x)
'''


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def test_iso_times(spark):
    f = lambda x: one(spark, iso_ts("t").cast("string"), t=x)
    assert f("2024-03-01T00:11:09") == f(" 2024-03-01 00:11:09Z") == f("2024-03-01T02:11:09+02:00") == "2024-03-01 00:11:09"
    assert f("soon") is None and f("") is None and f(None) is None and f("2024-03-01") == "2024-03-01 00:00:00"


def test_point_ids(spark):
    f = lambda x: one(spark, model.point_id(F.col("i")), i=x)
    assert f("abcdef0123456789") == "abcdef01-2345-6789-0000-000000000000"
    assert len(f("guide_chunk_3")) == 36


def test_chunks(spark):
    t = "aaa\n\n bb \n\n\n\ncccccccc\n\nd"
    rows = text.chunk_rows(spark.createDataFrame([(1, t), (2, ""), (3, None)], "k int, t string"), "k", "t", 5).orderBy("k", "chunk_index").collect()
    assert [(r.k, r.content) for r in rows] == [(1, "aaa\n\nbb"), (1, "cccccccc"), (1, "d")]
    lap = text.chunk_rows(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", 5, 2).orderBy("chunk_index").collect()
    assert [r.content for r in lap] == ["aaa\n\nbb", "bb\n\ncccccccc", "cc\n\nd"]
    assert one(spark, text.title(F.col("t")), t="x\n## The title \nz") == "The title" and one(spark, text.title(F.col("t")), t="no") is None
    assert one(spark, text.line_counts(F.col("t"))[0], t="") == 1 and one(spark, text.line_counts(F.col("t"))[1], t="a\n# b\n\n * c\n//d") == 1
    assert one(spark, text.wrap(F.col("t"), 7), t="aa bb ccc dddddddd e") == ["aa bb", "ccc", "dddddddd", "e"]
    s = text.sections(spark.createDataFrame([(1, "in\n## A\nb1\n## no body")], "k int, t string"), "k", "t").orderBy("section_no").collect()
    assert [(r.heading, r.body) for r in s] == [("Overview", "in"), ("A", "b1")]


@pytest.mark.parametrize(("question", "want", "name"), [
    ("Find the process_data function", "find_function", "process_data"), ("What does the validate_data function do?", "explain_code", None),
    ("Show me the DataProcessor class", "find_class", "dataprocessor"), ("hello there", "general_question", None), ("who calls 'run_all' now", "find_usage", "run_all"),
])
def test_intents(spark, question, want, name):
    c = intent.classify(F.col("q"))
    got = spark.createDataFrame([(question,)], "q string").select(c["intent"], intent.entity_name(F.col("q"), c["intent"])).first()
    assert got[0] == want and got[1] == name


def test_entities(spark):
    q = "Run 12 of src/app.js and lib/x.py 7"
    assert one(spark, intent.entity_path(F.col("q")), q=q) == "lib/x.py" and one(spark, intent.entity_numbers(F.col("q")), q=q) == [12, 7]


def test_trails_and_paths(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "1")], "src string, dst string")
    s = spark.createDataFrame([("1",)], "start string")
    got = {tuple(r.path) for r in expand.trails(e, s, 3).collect()}
    assert got == {("1", "2"), ("1", "2", "1")}
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "z")], "src string, dst string")
    pairs = spark.createDataFrame([("z", "a"), ("a", "nowhere")], "start string, target string")
    got = expand.shortest_paths(e, pairs, 5).collect()
    assert [(r.start, r.target, r.depth, r.path) for r in got] == [("z", "a", 3, ["z", "d", "b", "a"])]


def test_flow(spark):
    steps = spark.createDataFrame([(1, 1, 2.0, []), (1, 2, 3.0, [1]), (1, 3, 1.0, [1]), (1, 4, 4.0, [2, 3]), (2, 1, 0.0, [9]), (3, 1, 1.0, [2]), (3, 2, 1.0, [1])], "flow_id int, step int, minutes double, depends_on array<int>")
    got = {r.flow_id: (r.critical_time, r.critical_path) for r in flow.critical_paths(steps).collect()}
    assert got[1] == (9.0, "1,2,4") and got[2] == (1.0, "1") and got[3][1] == ""
    groups = flow.same_dependency_groups(steps).select("flow_id", "members").where("flow_id = 1")
    assert groups.first().members == [2, 3]
    s = flow.speedup(steps.where("flow_id = 1"), groups).first()
    assert (s.sequential, s.saved, s.parallel, s.speedup) == (10.0, 1.0, 9.0, 1.111111)


def test_context(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, item_id int, content string, source_type string, relevance_score double")
    items = make([(1, 1, "a" * 400, "code", 0.9), (1, 2, "b" * 4000, "code", 0.8), (1, 3, "c" * 40, "graph", 0.7), (1, 4, None, "code", 1.0), (1, 5, "a" * 400, "code", 0.95), (1, 6, "z", "code", 0.3), (1, 7, "y", None, None)])
    first = context.dedupe(items)
    assert {r.item_id for r in first.collect()} == {1, 2, 3, 6, 7}
    kept = context.within_budget(context.ranked(first), 500)
    assert [(r.item_id, r.tokens) for r in kept.collect()] == [(1, 100)]
    assert context.summary(kept).first().summary == "Retrieved 1 code units"
    assert context.within_budget(context.ranked(make([])), 10).count() == 0


def test_budget_is_a_prefix(spark):
    import random

    r = random.Random(1)
    rows = [(q, i, "x" * r.randrange(0, 400), "code", r.random()) for q in range(3) for i in range(200)]
    items = context.ranked(spark.createDataFrame(rows, "query_id int, item_id int, content string, source_type string, relevance_score double"))
    got = {(x.query_id, x.item_id) for x in context.within_budget(items, 900).collect()}
    want = set()
    for q in range(3):
        used = 0
        for x in sorted((x for x in rows if x[0] == q and x[4] > 0.3), key=lambda x: (-x[4], x[1])):
            used += len(x[2]) // 4
            if used > 900:
                break
            want.add((q, x[1]))
    assert got == want


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(60)] + [(90, None, 0), (91, [0.0, 0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    top = vector.search(v, [1.0, 1.0, 1.0], 3).collect()
    assert [r.vec_id for r in top] == [1, 22, 43]
    near = vector.knn(v.where("vec_id < 60"), v.where("vec_id in (0, 50)"), 4)
    for ask in (0, 50):
        q = [float(ask % 7), 1.0, float(ask % 3)]
        want = [r.vec_id for r in vector.search(v.where(f"vec_id < 60 and vec_id <> {ask}"), q, 4).collect()]
        assert [r.vec_id for r in near.where(f"query_id = {ask}").orderBy("rank").collect()] == want
    e = spark.createDataFrame([("abc",)], "t string").select(vector.hash_embedding(F.col("t"))).first()[0]
    assert len(e) == 384 and e[0] == 0xBA / 255 * 2 - 1


def test_roles_and_endpoints(spark):
    assert one(spark, detect.role(F.col("n")), n="validateAndGet") == "validation" and one(spark, detect.role(F.col("n")), n="zzz") == "processing"
    code = [(1, "go", 'r.Methods("POST").Path("/pay").Handler(x)'), (2, "JavaScript", "app.get('/a', f); router.POST(\"/b\", g)"), (3, "java", '@GetMapping("/c")\n@PostMapping("/d")'), (4, None, "app.get('/x')"), (5, "go", None)]
    got = {tuple(r) for r in detect.http_endpoints(spark.createDataFrame(code, "k int, language string, code string"), "k").collect()}
    assert got == {(1, "POST", "/pay"), (2, "GET", "/a"), (2, "POST", "/b"), (3, "GET", "/c"), (3, "POST", "/d")}


def test_parse_and_build(spark):
    rows = [("a/sample.py", "n", SAMPLE), ("a/bad.py", "n", "def f(:\n"), ("a/empty.py", "n", ""), ("a/m.go", "n", 'package m\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Run() { fmt.Println("} func x() {") }\n\nfunc main() { Run() }\n'), ("a/K.java", "n", "import a.B;\nclass K {\n    K() { }\n    int f(int x) {\n        return g(x);\n    }\n}\n"), ("a/j.js", "n", "import x from 'y';\nclass A {\n    m(a) { return f(a); }\n}\nconst f = (q) => { return q; };\n"), ("a/n.txt", "n", "x"), (None, "n", "x")]
    u = parse.units(spark.createDataFrame(rows, "file_path string, namespace string, code string"))
    got = {(r.file_path[2:], r.type, r.name, r.parent) for r in u.collect()}
    assert {x for x in got if x[0] == "sample.py"} == {("sample.py", t, n, p) for t, n, p in [("Module", "sample", None), ("Function", "process_data", None), ("Function", "clean_data", None), ("Function", "validate_data", None), ("Function", "transform_data", None), ("Class", "DataProcessor", None), ("Method", "__init__", "DataProcessor"), ("Method", "run", "DataProcessor")]}
    assert not any(x[0] in ("bad.py", "empty.py") for x in got)
    assert ("m.go", "Method", "Run", "T") in got and ("m.go", "Function", "main", None) in got and not any(x[2] == "x" for x in got)
    assert {("K.java", "Method", "f", "K"), ("K.java", "Method", "K", "K"), ("j.js", "Method", "m", "A"), ("j.js", "Function", "f", None)} <= got
    calls = graph.resolve_calls(u.where("file_path = 'a/sample.py'"))
    assert calls.count() == 4
    strict, loose = graph.containment(u.where("file_path = 'a/sample.py'"), True), graph.containment(u.where("file_path = 'a/sample.py'"))
    assert strict.where("parent_type = 'Class'").count() == 1 and loose.where("parent_type = 'Class'").count() == 2
    assert loose.where("parent_type = 'Module'").count() == 5


def test_merges(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], "id string, name string, n int")
    new = spark.createDataFrame([("a", None, 5), ("a", None, 4), ("c", "z", 1)], "id string, name string, n int")
    once = graph.merge_nodes(old, new, ["id"])
    assert {tuple(r) for r in once.collect()} == {("a", "x", 5), ("b", "y", None), ("c", "z", 1)}
    assert {tuple(r) for r in graph.merge_nodes(once, new, ["id"]).collect()} == {tuple(r) for r in once.collect()}


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"x = '\xe9'\n")
    (tmp_path / "src" / "b.TS").write_text("let x = 1")
    (tmp_path / "src" / "c.pyc").write_bytes(b"\x00")
    (tmp_path / "src" / "node_modules" / "d.js").write_text("1")
    got = {r.file_path.rsplit("/", 1)[-1]: (r.code, r.language) for r in files.scan(spark, str(tmp_path / "src"), exclude=["node_modules", "*.pyc"]).collect()}
    assert got == {"a.py": ("x = 'é'\n", "python"), "b.TS": ("let x = 1", "typescript")}
    assert files.scan(spark, str(tmp_path / "src"), include=["*.py", "a*"]).count() == 1
    t = str(tmp_path / "t")
    store.write(spark.createDataFrame([("n", "a", 1), ("m", "a", 1)], "namespace string, id string, v int"), t)
    store.upsert(spark, t, spark.createDataFrame([("n", "a", 2), ("n", "b", 3)], "namespace string, id string, v int"), ["namespace", "id"])
    assert {(r.namespace, r.id, r.v) for r in spark.read.parquet(t).collect()} == {("n", "a", 2), ("n", "b", 3), ("m", "a", 1)}
    store.upsert(spark, t, spark.createDataFrame([(None, "a", 7), (None, "c", 8)], "namespace string, id string, v int"), ["namespace", "id"])
    store.upsert(spark, t, spark.createDataFrame([(None, "a", 9)], "namespace string, id string, v int"), ["namespace", "id"])
    assert {(r.id, r.v) for r in spark.read.parquet(t).where("namespace is null").collect()} == {("a", 9), ("c", 8)}
    spark.read.parquet(t).where("namespace is not null").write.mode("overwrite").partitionBy("namespace").parquet(t + "2")
    t += "2"
    store.delete_namespace(spark, t, "n")
    assert {(r.namespace, r.v) for r in spark.read.parquet(t).collect()} == {("m", 1)}


def test_workflow(spark):
    doc = {"title": "T", "phases": [{"name": "P", "steps": [{"id": "1", "name": "a", "time": "5 minutes"}, {"id": "2", "name": "b", "time": "ongoing", "depends_on": ["1"]}, {"id": "3", "name": "c", "parallel_with": ["2"]}]}]}
    n, e = files.workflow(spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,)], "json string"))
    assert {(r.id, r.minutes) for r in n.where("label = 'Step'").collect()} == {("T:1", 5.0), ("T:2", None), ("T:3", None)}
    got = {(r.src, r.dst, r.type) for r in e.collect()}
    assert {("T:2", "T:1", "DEPENDS_ON"), ("T:3", "T:2", "PARALLEL_WITH"), ("T:2", "T:3", "PARALLEL_WITH"), ("T:2", "T:3", "FOLLOWS"), ("T", "T/P", "HAS_PHASE")} <= got
    assert ("T:1", "T:2", "FOLLOWS") not in got


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.py").write_text("x = 1")
    for _ in range(2):  # a second run without new files changes nothing
        ingest.keep_table(ingest.file_stream(spark, str(src), "n"), out, ["namespace", "file_path"], str(tmp_path / "cp")).awaitTermination()
    (src / "b.go").write_text("package b")
    ingest.keep_table(ingest.file_stream(spark, str(src), "n"), out, ["namespace", "file_path"], str(tmp_path / "cp")).awaitTermination()
    assert {r.language for r in spark.read.parquet(out).collect()} == {"python", "go"}


def test_hot_keys_are_numbered_and_split(spark, monkeypatch):
    import corvine.common as common

    monkeypatch.setattr(common.hot_keys, "__defaults__", (10,))
    rows = [("hot", i % 50, f"m{i:03}") for i in range(300)] + [("a", None, "x"), ("a", 1, "y"), ("b", 1, "z")]
    df = spark.createDataFrame(rows, "k string, o int, m string")
    got = {(r.k, r.m): r.place for r in common.numbered(df, "k", [F.col("o").asc_nulls_last(), F.col("m").asc()]).collect()}
    assert [m for _, m in sorted((p, m) for (k, m), p in got.items() if k == "hot")] == [m for _, _, m in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2]))]
    assert (got["a", "y"], got["a", "x"], got["b", "z"]) == (1, 2, 1)
    monkeypatch.setattr(common, "PART_ROWS", 30)
    parts = common.part_of_hot(df, "k", "m")
    assert parts.where("k = 'hot'").select("part").distinct().count() > 8 and parts.where("k <> 'hot'").select("part").distinct().collect()[0].part == 0
    assert parts.count() == len(rows)


def test_handler_chain(spark):
    code = 'r.Methods("POST").Path("/pay").Handler(http.NewServer(mw(e.AuthoriseEndpoint), decodeReq, encodeRes))'
    assert one(spark, detect.handler_chain(F.col("c"), "/pay"), c=code) == ["decodeReq", "Authorise", "encodeRes"]
    assert one(spark, detect.handler_chain(F.col("c"), "/x"), c=code) is None


def test_endpoints_go_by_extension(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "a/x.go", None, 'r.Methods("POST").Path("/pay").Handler(x)'), (2, "x.go", "golang", 'r.Methods("GET").Path("/go").Handler(x)'), (3, "b/y.JS", "js", "app.get('/a', f)"), (4, "K.java", "jvm", '@GetMapping("/c")'), (5, "z.py", "javascript", "app.get('/no', f)"), (6, None, "go", 'r.Methods("GET").Path("/no").Handler(x)')]
    spark.createDataFrame(rows, "file_id long, file_path string, language string, code string").write.parquet(str(tmp_path / "source_file.parquet"))
    assert {tuple(r) for r in entry.queries()["http_endpoints"](spark, str(tmp_path)).collect()} == {(1, "POST", "/pay"), (2, "GET", "/go"), (3, "GET", "/a"), (4, "GET", "/c")}


def test_callers_are_named_in_parts(spark, monkeypatch):
    import corvine.common as common
    from corvine.operators import retrieve

    monkeypatch.setattr(common, "PART_ROWS", 10)
    names = [f"c{i:03}" for i in range(100)]
    n = spark.createDataFrame([(x, x.upper(), "Function", "n", "f") for x in (*names, "poll", "lone")] + [("k", "K", "Class", "n", "f")], "id string, name string, label string, namespace string, file_path string")
    e = spark.createDataFrame([(x, "poll", "CALLS") for x in names] + [("poll", "c000", "CALLS"), ("k", "poll", "CONTAINS")], "src string, dst string, type string")
    for got in (graph.function_lists(n, e).where("id = 'poll'").collect(), retrieve.retrieve("find_usage", n, e, None, "n", "poll")["graph"].collect(), retrieve.function_with_context(n, e, n.where("id = 'poll'").select("id")).collect()):
        assert sorted(x for r in got for x in r.callers.split(",") if x) == [x.upper() for x in names] and sum(r.n_callers for r in got) == 100
        assert len(got) > 8 and len({r.part for r in got}) == len(got) and {r.callees for r in got} == {"", "C000"} and {r.parents for r in got} == {"", "K"}
    lone = graph.function_lists(n, e).where("id = 'lone'").collect()
    assert [tuple(r) for r in lone] == [("lone", "LONE", 0, "", "", "", 0)]


def _tables(spark, d, edges, units):
    null = lambda t: F.lit(None).cast(t)
    u = spark.createDataFrame([(i, name, kind, path, code, calls) for i, name, kind, path, code, calls in units], "id string, name string, type string, file_path string, code string, calls array<string>")
    u = u.withColumns({"namespace": F.lit("shop:pay"), "language": F.lit("go"), "line_start": F.lit(1), "line_end": F.lit(2), "complexity": null("int"), "imports": null("array<string>"), **{c: null("string") for c in ("signature", "docstring", "parent_id")}})
    u.write.parquet(f"{d}/code_unit.parquet")
    spark.createDataFrame(edges, "from_id string, to_id string, type string").withColumns({"call_count": null("int"), "is_recursive": null("boolean"), "import_type": null("string"), "dependency_type": null("string"), "order_no": null("int")}).write.parquet(f"{d}/graph_edge.parquet")
    spark.createDataFrame([], "id string, name string, label string, namespace string, file_path string").write.parquet(f"{d}/graph_node.parquet")
    spark.createDataFrame([], "symbol_id string, symbol string, language string").write.parquet(f"{d}/external_symbol.parquet")


def test_flows_of_all_entries(spark, tmp_path):
    import __spark_entry__ as entry

    q, d = entry.queries(), str(tmp_path)
    _tables(spark, d, [(f"f{i}", f"f{i + 1}", "CALLS") for i in range(12)], [("f0", "main", "Function", "a.go", "", None), *[(f"f{i}", f"step{i}", "Function", "a.go", "", None) for i in range(1, 13)]])
    assert [tuple(r) for r in q["all_entry_flows"](spark, d).collect()] == [("f0", 10, 9)] and q["entry_flows"](spark, d).count() == 0
    assert tuple(q["all_flow_summary"](spark, d).first()) == (1, 10, 9.0, 9)
    assert [r.line for r in q["all_flow_outline"](spark, d).orderBy("depth").collect()][:3] == ["- main", "  - step1", "    - step2"]


def test_impact_and_subgraph_over_all_types(spark):
    e = spark.createDataFrame([("m", "f", "CONTAINS"), ("x", "m", "IMPORTS"), ("f", "g", "CALLS"), ("f", "g", "USES"), ("m", "k", "CONTAINS")], "src string, dst string, type string")
    s = spark.createDataFrame([("f",)], "start string")
    assert {(r.node, r.distance) for r in graph.impact(e, s, 5).collect()} == {("m", 1), ("x", 2)}
    got = {r.node: (r.depth, r.trails, r.types) for r in expand.subgraph(e, s, 2).collect()}
    assert got == {"m": (1, 1, "CONTAINS"), "g": (1, 2, "CALLS,USES"), "x": (2, 1, "CONTAINS,IMPORTS"), "k": (2, 1, "CONTAINS"), "f": (2, 2, "CALLS,USES")}


def test_request_flows(spark, tmp_path):
    import __spark_entry__ as entry

    code = 'r.Methods("POST").Path("/pay.x").Handler(http.NewServer(mw(e.AuthoriseEndpoint), decodeReq, encodeRes))\nr.Methods("GET").Path("/health").Handler(h)'
    _tables(spark, str(tmp_path), [], [("1", "MakeHTTPHandler", "Function", "a/t.go", code, None), ("2", "other", "Function", "a/t.go", code, None), ("3", "AuthoriseEndpoint", "Function", "a/e.go", "", ["s.verify", "log.x", "a", "b", "c", "d"])])
    got = {r.path: r for r in entry.queries()["request_flows"](spark, str(tmp_path)).collect()}
    assert set(got) == {"/pay.x", "/health"} and got["/health"].endpoint is None and got["/health"].n_calls == 0
    r = got["/pay.x"]
    assert (r.entry_id, r.method, r.decoder, r.endpoint, r.encoder, r.endpoint_id, r.n_calls) == ("1", "POST", "decodeReq", "Authorise", "encodeRes", "3", 6)
    assert r.first_calls == "s.verify (validation), log.x (logging), a (processing), b (processing), c (processing)"


def test_steps_around_and_along(spark):
    n = spark.createDataFrame([(x, x.upper(), "Step") for x in "abcd"] + [("p", "P", "Phase")], "id string, name string, label string")
    e = spark.createDataFrame([("a", "b", "F"), ("b", "c", "F"), ("a", "c", "F"), ("c", "d", "F"), ("b", "a", "DEPENDS_ON"), ("b", "c", "PARALLEL_WITH"), ("d", "b", "DEPENDS_ON"), ("p", "b", "CONTAINS")], "src string, dst string, type string")
    assert {(r.start, r.node, r.path) for r in graph.root_leaf_paths(e, "F").collect()} == {("a", "d", "a/b/c/d"), ("a", "d", "a/c/d")}
    got = {r.id: (r.dependencies, r.parallel_steps, r.next_steps, r.phases) for r in graph.step_neighbourhood(n, e).collect()}
    assert got["b"] == ("A", "C", "D", "P") and got["a"] == ("", "", "B", "") and got["c"] == ("", "", "", "")
