"""Graph lookups, neighbourhoods, statistics and changes over nodes N and edges E (see corvine.model)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.common import numbered, part_of_hot
from corvine.model import service
from corvine.operators import expand

CODE = ("Function", "Method")


def _n(n: DataFrame, prefix: str) -> DataFrame:
    return n.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "name", "label", "namespace", "file_path")])


def ends(n: DataFrame, e: DataFrame, kind: str) -> DataFrame:
    """Edges of a type with both their nodes: columns src_*, dst_* and the edge's own."""
    of = e.where(F.col("type") == kind)
    return of.join(_n(n, "src"), F.col("src") == F.col("src_id")).join(_n(n, "dst"), F.col("dst") == F.col("dst_id"))


def function_calls(n: DataFrame, e: DataFrame, namespace: str) -> DataFrame:
    """G1: calls between functions, the caller in a namespace."""
    c = ends(n, e, "CALLS").where((F.col("src_namespace") == namespace) & F.col("src_label").isin(*CODE) & F.col("dst_label").isin(*CODE))
    return c.select(F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"), F.col("src_id").alias("caller_id"), F.col("dst_id").alias("callee_id"), F.coalesce("call_count", F.lit(1)).alias("call_count"), F.coalesce("is_recursive", F.lit(False)).alias("is_recursive"))


def class_hierarchy(n: DataFrame, e: DataFrame, depth: int | None = None) -> DataFrame:
    """Every (class, ancestor) over INHERITS_FROM with the path of ids, of any length without a depth."""
    inh = e.where("type = 'INHERITS_FROM'")
    t = expand.trails(inh, inh.select(F.col("src").alias("start")).distinct(), depth)
    return t.select(F.col("start").alias("class_id"), F.col("node").alias("ancestor_id"), "depth", F.array_join("path", "/").alias("path"))


def module_dependencies(n: DataFrame, e: DataFrame) -> DataFrame:
    """Per importing node the sorted imported names and kinds of import; the lists of a hot node come in parts."""
    i = part_of_hot(ends(n, e, "IMPORTS"), "src_id", "dst_id")
    return i.groupBy("src_id", "part").agg(F.first("src_name").alias("module"), F.count("*").alias("n_imports"), F.array_join(F.array_sort(F.collect_set("dst_name")), ",").alias("imports"), F.array_join(F.array_sort(F.collect_set("import_type")), ",").alias("import_types")).withColumnRenamed("src_id", "module_id")


def named_lists(n: DataFrame, e: DataFrame, of: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """(id, part, and for each list its sorted distinct names and ``n_`` its number of nodes) of the nodes that have any.

    of: a list's name to (type, direction, label at the other end or None). All lists of a node hot in any come in parts,
    a row each, and a neighbour is in one part only, so that numbers add up over the parts.
    """
    x = e.where(F.col("type").isin(sorted({t for t, _, _ in of.values()}))).select("src", "dst", "type")
    x = x.join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("label").alias("src_label")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("label").alias("dst_label")), "dst")
    rows = []
    for k, (t, direction, label) in of.items():
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        hit = (F.col("type") == t) & (F.col(f"{b}_label") == label if label else F.lit(True))
        rows.append(F.when(hit, F.struct(F.col(a).alias("id"), F.lit(k).alias("list"), F.col(b).alias("other"), F.col(f"{b}_name").alias("other_name"))))
    x = x.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    x = part_of_hot(x, "id", "other")
    cols = []
    for k in of:
        here = F.col("list") == k
        cols += [F.array_join(F.array_sort(F.collect_set(F.when(here, F.col("other_name")))), ",").alias(k), F.count_distinct(F.when(here, F.col("other"))).alias(f"n_{k}")]
    return x.groupBy("id", "part").agg(*cols)


def function_lists(n: DataFrame, e: DataFrame) -> DataFrame:
    """Per function its distinct callee and caller names and parent classes; a hot function has a row for each part."""
    lists = named_lists(n, e, {"callees": ("CALLS", "out", None), "callers": ("CALLS", "in", None), "parents": ("CONTAINS", "in", "Class")})
    out = n.where(F.col("label").isin(*CODE)).select("id", "name").join(lists, "id", "left")
    return out.select("id", "name", F.coalesce("part", F.lit(0)).alias("part"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("callees", "callers", "parents")], F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def function_context(n: DataFrame, e: DataFrame) -> DataFrame:
    """G4 with callers counted: per function its distinct callee names and parent classes and its number of callers, in one
    row; function_lists names the callers and bounds the lists."""
    calls = ends(n, e, "CALLS")
    names = lambda side, other, out: calls.groupBy(F.col(side).alias("id")).agg(F.array_join(F.array_sort(F.collect_set(other)), ",").alias(out))
    parent = ends(n, e, "CONTAINS").where("src_label = 'Class'").groupBy(F.col("dst_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("src_name")), ",").alias("parents"))
    callers = calls.groupBy(F.col("dst_id").alias("id")).agg(F.count_distinct("src_id").alias("n_callers"))
    base = n.where(F.col("label").isin(*CODE)).select("id", "name")
    out = base.join(names("src_id", "dst_name", "callees"), "id", "left").join(callers, "id", "left").join(parent, "id", "left")
    return out.select("id", "name", F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("parents", F.lit("")).alias("parents"))


def grouped_neighbours(n: DataFrame, e: DataFrame, kind: str, direction: str = "out") -> DataFrame:
    """Per node the sorted distinct names at the other end of a type. The list of a hot node comes in
    several parts, a row each."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    x = part_of_hot(ends(n, e, kind), f"{a}_id", f"{b}_id")
    return x.groupBy(F.col(f"{a}_id").alias("id"), F.col(f"{a}_name").alias("name"), "part").agg(F.count_distinct(f"{b}_id").alias("n"), F.array_join(F.array_sort(F.collect_set(f"{b}_name")), ",").alias("others"))


def without_edge(n: DataFrame, e: DataFrame, kind: str, label: tuple[str, ...], out: bool = True, into: bool = False) -> DataFrame:
    """Nodes of labels without outgoing and/or incoming edges of a type."""
    left = n.where(F.col("label").isin(*label)).select("id", "name", "namespace")
    of = e.where(F.col("type") == kind)
    if out:
        left = left.join(of.select(F.col("src").alias("id")), "id", "left_anti")
    if into:
        left = left.join(of.select(F.col("dst").alias("id")), "id", "left_anti")
    return left


def ordered_children(n: DataFrame, e: DataFrame, kind: str) -> DataFrame:
    """Children of a type in their stored order, numbered."""
    x = ends(n, e, kind).select("src_id", "order_no", "dst_id", "dst_name")
    x = numbered(x, "src_id", [F.col("order_no").asc_nulls_last(), F.col("dst_id").asc()])
    return x.select(F.col("src_id").alias("parent_id"), "place", F.col("dst_id").alias("child_id"), F.col("dst_name").alias("child"))


def search_by_name(n: DataFrame, namespace: str, term: str, limit: int) -> DataFrame:
    """Names that hold a term in any case, in a total order."""
    return n.where((F.col("namespace") == namespace) & F.contains(F.lower("name"), F.lit(term.lower()))).select("id", "name", "label").orderBy("name", "id").limit(limit)


def search_any(n: DataFrame, words: list[str]) -> DataFrame:
    """A3: names that hold any of the words."""
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(F.lower("name"), F.lit(w.lower()))
    return n.where(cond).select("id", "name", "namespace")


def nodes_of_files(n: DataFrame, namespace: str) -> DataFrame:
    """The nodes of a namespace that lie in files, with all their properties."""
    return n.where((F.col("namespace") == namespace) & F.col("file_path").isNotNull())


def get_node(n: DataFrame, node_id: Column, label: str | None = None, namespace: str | None = None) -> DataFrame:
    """The node of an id, of a label and namespace where given; no row without one."""
    hit = n.where(F.col("id") == node_id)
    hit = hit if label is None else hit.where(F.col("label") == label)
    return (hit if namespace is None else hit.where(F.col("namespace") == namespace)).limit(1)


def create_nodes(n: DataFrame, new: DataFrame) -> DataFrame:
    """(the new rows, created): false for an id that exists or comes twice, which a plain create may not add again."""
    own = new.groupBy("id").agg(F.count("*").alias("_n"))
    old = n.select("id").distinct().withColumn("_old", F.lit(True))
    return new.join(own, "id").join(old, "id", "left").withColumn("created", F.col("_old").isNull() & (F.col("_n") == 1)).drop("_n", "_old")


def delete_nodes(n: DataFrame, e: DataFrame, gone: DataFrame, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (id), and the edges left. Unless detached, a node that has edges stays."""
    gone = gone.select("id").distinct()
    if not detach:
        used = e.select(F.explode(F.array("src", "dst")).alias("id"))
        gone = gone.join(used, "id", "left_anti")
    left = e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return n.join(gone, "id", "left_anti"), left


def namespace_stats(n: DataFrame) -> DataFrame:
    """Nodes per namespace and label."""
    return n.groupBy("namespace", "label").agg(F.count("*").alias("nodes"))


def graph_stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """T4: nodes per namespace, and edges by the namespace of their source."""
    a = n.groupBy("namespace").agg(F.count("*").alias("nodes"))
    b = e.join(n.select(F.col("id").alias("src"), "namespace"), "src").groupBy("namespace").agg(F.count("*").alias("edges"))
    return a.join(b.withColumnRenamed("namespace", "_ns"), F.col("namespace").eqNullSafe(F.col("_ns")), "left").select("namespace", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def degree_top(n: DataFrame, e: DataFrame, kind: str, direction: str, limit: int) -> DataFrame:
    """Nodes with most edges of a type in or out; counted before the names are joined."""
    side = "dst" if direction == "in" else "src"
    top = e.where(F.col("type") == kind).groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    return top.join(n.select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(limit)


def most_complex(n: DataFrame, limit: int) -> DataFrame:
    """The most complex functions."""
    return n.where(F.col("label").isin(*CODE) & F.col("complexity").isNotNull()).select("id", "name", "complexity").orderBy(F.desc("complexity"), "id").limit(limit)


def call_chains(n: DataFrame, e: DataFrame, starts: DataFrame, depth: int, filtered: Column | None = None) -> DataFrame:
    """Trails over CALLS from start ids, with the name at the end."""
    t = expand.trails(e.where("type = 'CALLS'"), starts, depth)
    t = t.join(n.select(F.col("id").alias("node"), F.col("name").alias("end_name"), F.col("label").alias("end_label")), "node")
    t = t if filtered is None else t.where(filtered)
    return t.select("start", "node", "end_name", "depth", F.array_join("path", "/").alias("path"))


def root_leaf_paths(e: DataFrame, kind: str) -> DataFrame:
    """(start, node, depth, path) of the trails of a type from nodes without an incoming to nodes without an outgoing
    edge of it, of any length."""
    of = e.where(F.col("type") == kind)
    roots = of.select(F.col("src").alias("start")).distinct().join(of.select(F.col("dst").alias("start")), "start", "left_anti")
    t = expand.trails(of, roots, None).join(of.select(F.col("src").alias("node")), "node", "left_anti")
    return t.select("start", "node", "depth", F.array_join("path", "/").alias("path"))


def step_neighbourhood(n: DataFrame, e: DataFrame) -> DataFrame:
    """Per step the names of its dependencies, parallel steps, next steps (that depend on it) and phases, in parts."""
    lists = named_lists(n, e, {"dependencies": ("DEPENDS_ON", "out", "Step"), "parallel_steps": ("PARALLEL_WITH", "out", "Step"), "next_steps": ("DEPENDS_ON", "in", "Step"), "phases": ("CONTAINS", "in", "Phase")})
    out = n.where("label = 'Step'").select("id", "name").join(lists, "id", "left")
    return out.select("id", "name", F.coalesce("part", F.lit(0)).alias("part"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("dependencies", "parallel_steps", "next_steps", "phases")])


def impact(e: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, node, distance) of all nodes that reach a target over edges of any type."""
    t = expand.reach(e, targets, depth, "in")
    return t.where("depth > 0").select(F.col("start").alias("target"), "node", F.col("depth").alias("distance"))


def relationships(n: DataFrame, e: DataFrame, of: DataFrame) -> DataFrame:
    """Edges of given ids both ways, with the other node."""
    out = e.join(of.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other_id"))
    into = e.join(of.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "type", F.col("src").alias("other_id"))
    return out.unionByName(into).join(n.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id", "left")


def reverse_calls(n: DataFrame, e: DataFrame, name: str) -> DataFrame:
    """Distinct callers of the functions of a name."""
    return ends(n, e, "CALLS").where(F.col("dst_name") == name).select(F.col("src_id").alias("caller_id"), F.col("src_name").alias("caller"), F.col("src_file_path").alias("file_path")).distinct()


def layer_of(path: str) -> Column:
    """The layer of a file by words in its path, null without one."""
    c = F.col(path)
    return F.when(c.contains("/api/") | c.contains("/channel/"), "api").when(c.contains("/worker/") | c.contains("/job/"), "worker").when(c.contains("/cart/") | c.contains("/ledger/"), "store")


def layer_matrix(n: DataFrame, e: DataFrame) -> DataFrame:
    """Calls between all pairs of layers, zeros included; one aggregate instead of a query per pair."""
    x = ends(n, e, "CALLS").select(layer_of("src_file_path").alias("from_layer"), layer_of("dst_file_path").alias("to_layer")).where("from_layer is not null and to_layer is not null")
    got = x.groupBy("from_layer", "to_layer").agg(F.count("*").alias("calls"))
    names = F.array(*[F.lit(x) for x in ("api", "worker", "store")])
    grid = e.sparkSession.range(1).select(F.explode(names).alias("from_layer")).select("from_layer", F.explode(names).alias("to_layer"))
    return grid.join(got, ["from_layer", "to_layer"], "left").select("from_layer", "to_layer", F.coalesce("calls", F.lit(0)).alias("calls"))


def role_matrix(n: DataFrame, e: DataFrame, role: Callable[[Column], Column]) -> DataFrame:
    """A11 by roles of names instead of paths: calls per pair of roles."""
    x = ends(n, e, "CALLS").select(role(F.col("src_name")).alias("from_role"), role(F.col("dst_name")).alias("to_role"))
    return x.groupBy("from_role", "to_role").agg(F.count("*").alias("calls"))


def role_chain(n: DataFrame, e: DataFrame, role: Callable[[Column], Column], roles: tuple[str, str, str]) -> DataFrame:
    """T11 by roles: (mid, chains) of a calls b calls c with each in its own role; counted at the middle."""
    calls = e.where("type = 'CALLS'").select("src", "dst")
    of = n.select("id", role(F.col("name")).alias("_role"))
    side = lambda k, name: of.where(F.col("_role") == roles[k]).select(F.col("id").alias(name))
    left = calls.join(side(0, "src"), "src", "left_semi").groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("n_in"))
    right = calls.join(side(2, "dst"), "dst", "left_semi").groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n_out"))
    return left.join(right, "mid").join(side(1, "mid"), "mid", "left_semi").select("mid", (F.col("n_in") * F.col("n_out")).alias("chains"))


def cross_namespace_edges(n: DataFrame, e: DataFrame) -> DataFrame:
    """T14 over all types: edges whose ends lie in different namespaces, per type and pair."""
    ns = n.select("id", "namespace")
    x = e.join(ns.toDF("src", "from_ns"), "src").join(ns.toDF("dst", "to_ns"), "dst").where("from_ns <> to_ns")
    return x.groupBy("type", "from_ns", "to_ns").agg(F.count("*").alias("edges"))


def entry_to_target(n: DataFrame, e: DataFrame, starts: DataFrame, targets: DataFrame, depth: int, k: int) -> DataFrame:
    """Per start the first k trails of calls to any target, the shortest first, with the names along them."""
    t = expand.trails(e.where("type = 'CALLS'"), starts, depth).join(targets.select(F.col("id").alias("node")), "node", "left_semi")
    w = Window.partitionBy("start").orderBy("depth", "path")
    t = t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    names = t.select("start", "place", F.posexplode("path").alias("_at", "id")).join(n.select("id", "name"), "id")
    texts = names.groupBy("start", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda x: x["name"]), " -> ").alias("names"))
    return t.join(texts, ["start", "place"]).select("start", F.col("node").alias("target"), "depth", "place", "names")


def layer_chain(n: DataFrame, e: DataFrame) -> DataFrame:
    """A calls b calls c with each in its own layer; the middle is counted before the names are joined."""
    calls = e.where("type = 'CALLS'").select("src", "dst")
    lay = n.select("id", layer_of("file_path").alias("layer")).where("layer is not null")
    ab = calls.join(lay.where("layer = 'api'").select(F.col("id").alias("src")), "src", "left_semi")
    bc = calls.join(lay.where("layer = 'store'").select(F.col("id").alias("dst")), "dst", "left_semi")
    mid = lay.where("layer = 'worker'").select(F.col("id").alias("mid"))
    left = ab.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("n_in"))
    right = bc.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n_out"))
    return left.join(right, "mid").join(mid, "mid", "left_semi").select("mid", (F.col("n_in") * F.col("n_out")).alias("chains"))


def cross_namespace(n: DataFrame, e: DataFrame) -> DataFrame:
    """Calls whose ends lie in different namespaces, per pair."""
    return ends(n, e, "CALLS").where("src_namespace <> dst_namespace").groupBy(F.col("src_namespace").alias("from_ns"), F.col("dst_namespace").alias("to_ns")).agg(F.count("*").alias("calls"))


def service_language(n: DataFrame) -> DataFrame:
    """A2: units per service and language, with subtotals and the total (nulls)."""
    return n.where(F.col("label").isin(*CODE)).select(service().alias("service"), F.coalesce("language", F.lit("?")).alias("language")).rollup("service", "language").agg(F.count("*").alias("units"))


def completeness(n: DataFrame, e: DataFrame) -> DataFrame:
    """A4 per service: functions, and those with an outgoing call; completeness_by_language has it whole."""
    callers = e.where("type = 'CALLS'").select(F.col("src").alias("id")).distinct().withColumn("_calls", F.lit(1))
    x = n.where(F.col("label").isin(*CODE)).join(callers, "id", "left")
    return x.groupBy(service().alias("service")).agg(F.count("*").alias("functions"), F.count("_calls").alias("with_calls"))


def completeness_by_language(units: DataFrame, e: DataFrame) -> DataFrame:
    """A4: per service and language functions, those that list calls and those with an outgoing call."""
    callers = e.where("type = 'CALLS'").select(F.col("src").alias("id")).distinct().withColumn("_calls", F.lit(1))
    x = units.where(F.col("type").isin(*CODE)).join(callers, "id", "left")
    return x.groupBy(service().alias("service"), "language").agg(F.count("*").alias("functions"), F.count_if(F.size("calls") > 0).alias("listing_calls"), F.count("_calls").alias("with_calls"))


def expected_call_gaps(units: DataFrame, e: DataFrame) -> DataFrame:
    """(id, call) of the calls on the service that a function's code holds and no CALLS edge to a node of that name
    in the namespace follows."""
    f = units.where(F.col("type").isin(*CODE))
    said = f.select("id", "namespace", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b\w\.(\w+)\("), 1))).alias("call"))
    made = e.where("type = 'CALLS'").select(F.col("src").alias("id"), "dst").join(units.select(F.col("id").alias("dst"), F.col("name").alias("call"), "namespace"), "dst").select("id", "namespace", "call").distinct()
    return said.join(made, ["id", "namespace", "call"], "left_anti").select("id", "call")


def conversion(units: DataFrame, e: DataFrame) -> DataFrame:
    """Per namespace, elements of the calls lists against CALLS edges, and their ratio."""
    out = e.where("type = 'CALLS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_e"))
    x = units.select("id", "namespace", F.greatest(F.size("calls"), F.lit(0)).alias("_c")).join(out, "id", "left")
    s = x.groupBy("namespace").agg(F.sum("_c").alias("listed"), F.sum(F.coalesce("_e", F.lit(0))).alias("edges"))
    return s.withColumn("rate", F.round(F.col("edges") / F.nullif(F.col("listed"), F.lit(0)), 4))


def merge_nodes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert by key: new values win where they aren't null, other rows of both stay. ``new`` is made unique."""
    cols = [c for c in old.columns if c not in key]
    fresh = new.groupBy(*key).agg(*[F.max(c).alias(f"_{c}") for c in cols])
    return old.join(fresh, key, "full").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def merge_edges(old: DataFrame, new: DataFrame, n: DataFrame) -> DataFrame:
    """Add edges between existing nodes, one per ends and type; properties of new ones win."""
    ok = new.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return merge_nodes(old, ok, ["src", "dst", "type"])


def delete_namespace(n: DataFrame, e: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without a namespace's, and edges that touch none of those."""
    gone = n.where(F.col("namespace") == namespace).select("id")
    left = e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return n.where((F.col("namespace") != namespace) | F.col("namespace").isNull()), left


def containment(units: DataFrame, strict: bool = False) -> DataFrame:
    """B1, B2: CONTAINS by place in the file: module to class and function, class to method by lines (ends may meet
    unless strict). A range join on the file: both sides are co-partitioned by namespace and file."""
    key = ["namespace", "file_path"]
    u = units.select("id", "type", *key, "line_start", "line_end")
    side = lambda kind, name, lines: u.where(F.col("type").isin(*kind)).select(F.col("id").alias(name), *key, *[F.col(c).alias(f"_{name}_{c}") for c in lines])
    lines = ("line_start", "line_end")
    top = side(["Module"], "parent_id", ()).join(side(["Class", "Function"], "child_id", ()), key).select("parent_id", "child_id", F.lit("Module").alias("parent_type"))
    inner = side(["Class"], "parent_id", lines).join(side(["Method"], "child_id", lines), key)
    end = F.col("_child_id_line_end") < F.col("_parent_id_line_end") if strict else F.col("_child_id_line_end") <= F.col("_parent_id_line_end")
    inner = inner.where((F.col("_child_id_line_start") > F.col("_parent_id_line_start")) & end)
    return top.unionByName(inner.select("parent_id", "child_id", F.lit("Class").alias("parent_type")))


def resolve_calls_in_file(units: DataFrame) -> DataFrame:
    """CALLS by the whole element within the file; of functions of one name the last one. A dotted element names none."""
    key = ["namespace", "file_path"]
    f = units.where(F.col("type").isin(*CODE))
    targets = f.groupBy(*key, F.col("name").alias("call")).agg(F.max_by("id", F.struct("line_start", "id")).alias("dst"))
    calls = f.select(F.col("id").alias("src"), *key, F.explode("calls").alias("call")).where("call is not null")
    return calls.join(targets, [*key, "call"]).select("src", "dst").distinct().withColumn("call_count", F.lit(1))


def rebuild_counts(units: DataFrame, e: DataFrame) -> DataFrame:
    """B4's counters per namespace: listed calls, those whose edge exists, is created, or has no target, and the rate of those
    that have one."""
    hit = call_targets(units)
    old = e.where("type = 'CALLS'").select("src", "dst", F.lit(True).alias("_old"))
    x = hit.join(old, ["src", "dst"], "left")
    c = x.groupBy("namespace").agg(
        F.count("*").alias("calls"), F.count_if(F.col("dst").isNotNull() & F.col("_old").isNotNull()).alias("existing"),
        F.count_if(F.col("dst").isNotNull() & F.col("_old").isNull()).alias("created"), F.count_if(F.col("dst").isNull()).alias("not_found"),
    )
    return c.withColumn("rate", F.round((F.col("calls") - F.col("not_found")) / F.col("calls"), 4))


def resolve_calls(units: DataFrame) -> DataFrame:
    """CALLS by name within the namespace, see call_targets, one edge per caller and callee."""
    return call_targets(units).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("call_count"))


def call_targets(units: DataFrame) -> DataFrame:
    """(src, namespace, call, dst) of the distinct listed calls: the function of the full name in the namespace, else of the
    name behind one of a few receivers, the smallest id of several, null without one. Names are looked up once per
    (namespace, name)."""
    receivers = ("s", "ctx", "w", "r", "logger", "client")
    calls = units.where(F.col("type").isin(*CODE)).select(F.col("id").alias("src"), "namespace", F.explode("calls").alias("call")).where("call is not null")
    targets = units.where(F.col("type").isin(*CODE)).groupBy("namespace", "name").agg(F.min("id").alias("dst"))
    two = (F.size(F.split("call", r"\.")) == 2) & F.split_part("call", F.lit("."), F.lit(1)).isin(*receivers)
    calls = calls.distinct().withColumn("short", F.when(two, F.split_part("call", F.lit("."), F.lit(2))))
    full = calls.join(targets.withColumnRenamed("name", "call").withColumnRenamed("dst", "d1"), ["namespace", "call"], "left")
    both = full.join(targets.withColumnRenamed("name", "short").withColumnRenamed("dst", "d2"), ["namespace", "short"], "left")
    return both.select("src", "namespace", "call", F.coalesce("d1", "d2").alias("dst"))


def import_edges(units: DataFrame) -> DataFrame:
    """IMPORTS from a module to the modules of its namespace that bear an imported name's last part."""
    mods = units.where("type = 'Module'")
    i = mods.select(F.col("id").alias("src"), "namespace", F.explode("imports").alias("imported")).withColumn("name", F.element_at(F.split("imported", r"[./]"), -1))
    t = mods.groupBy("namespace", "name").agg(F.min("id").alias("dst"))
    return i.join(t, ["namespace", "name"]).where("src <> dst").select("src", "dst").distinct()


def duplicates(n: DataFrame) -> DataFrame:
    """Ids that break uniqueness, with their number of rows."""
    return n.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
