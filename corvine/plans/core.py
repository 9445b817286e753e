"""Queries of the graph, vector, flow, text and context operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine import model
from corvine.common import PART_ROWS, norm_id, table
from corvine.functions import text
from corvine.operators import context, detect, expand, flow, graph, intent, vector
from corvine.sources.files import language_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NS = "shopmesh:gateway"
WORDS = ["merge", "route", "poll"]

_B = "E' \\t\\r\\n'"
_T = "try_cast(CASE WHEN regexp_matches(trim({0}, " + _B + "), '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND length(trim({0}, " + _B + ")) > 10 THEN trim({0}, " + _B + ") ELSE trim({0}, " + _B + ") || 'Z' END AS TIMESTAMPTZ)"


def _last(key: str, columns: list[str], rows: str) -> str:
    """The row of the last load for each key; rows of one time by their columns, the greatest."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["tm", *columns])
    return f"SELECT {key}, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({rows})) WHERE rn = 1"


_C = _T.format("created_at")
_NODE_ROWS = f"""SELECT lower(trim(id, {_B})) AS id, name, type AS label, namespace, file_path, language, complexity, {_C} AS tm FROM code_unit WHERE id IS NOT NULL
  UNION ALL SELECT lower(trim(id, {_B})), name, label, namespace, file_path, NULL, NULL, coalesce({_T.format("updated_at")}, {_C}) FROM graph_node WHERE id IS NOT NULL
  UNION ALL SELECT lower(trim(symbol_id, {_B})), symbol, 'Symbol', NULL, NULL, language, NULL, NULL FROM external_symbol WHERE symbol_id IS NOT NULL"""
N = f"N AS ({_last('id', model.NODE_COLUMNS, _NODE_ROWS)})"
_EDGE_ROWS = f"SELECT lower(trim(from_id, {_B})) AS src, lower(trim(to_id, {_B})) AS dst, nullif(upper(trim(type, {_B})), '') AS type, call_count, is_recursive, import_type, dependency_type, order_no, {_C} AS tm FROM graph_edge WHERE from_id IS NOT NULL AND to_id IS NOT NULL"
E = f"E AS ({_last('src, dst, type', model.EDGE_COLUMNS, _EDGE_ROWS)})"
X = """X AS (SELECT E.*, a.id AS src_id, a.name AS src_name, a.label AS src_label, a.namespace AS src_namespace, a.file_path AS src_file_path,
  b.id AS dst_id, b.name AS dst_name, b.label AS dst_label, b.namespace AS dst_namespace, b.file_path AS dst_file_path FROM E JOIN N a ON a.id = E.src JOIN N b ON b.id = E.dst)"""
_UNIT_ROWS = f"SELECT * REPLACE (lower(trim(id, {_B})) AS id), {_C} AS tm FROM code_unit WHERE id IS NOT NULL"
U = f"U AS ({_last('id', model.UNIT_COLUMNS, _UNIT_ROWS)})"
S = """S AS (SELECT *, CASE flag WHEN 'A' THEN list_filter([step - 1], lambda x: x >= 1) WHEN 'R' THEN list_filter([step - 2, step - 1], lambda x: x >= 1) ELSE [] END AS depends_on FROM (
  SELECT l_orderkey AS flow_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS step, l_partkey AS part, l_quantity AS minutes, l_returnflag AS flag, l_linestatus AS status FROM lineitem)),
NB AS (SELECT a.flow_id, a.step, b.step AS other FROM S a JOIN S b ON b.flow_id = a.flow_id AND b.step = a.step + 1 WHERE a.flag = 'N' AND b.flag = 'N' AND a.status = b.status),
PP AS (SELECT * FROM NB UNION ALL SELECT flow_id, other, step FROM NB)"""
G = f"WITH {N}, {E}, {X} "
GR = f"WITH RECURSIVE {N}, {E}, {X}"
FL = f"WITH {S} "


def q(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def simple(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None) -> None:
    """A query over nodes and edges."""
    q(name, sql)(lambda s, d: f(model.nodes(s, d), model.edges(s, d)))


def _part(key: str, member: str) -> str:
    """The part of a long list that a member stands in, see corvine.common.part_of_hot."""
    n = f"count(*) OVER (PARTITION BY {key})"
    return f"CASE WHEN {n} > {PART_ROWS} THEN CAST(('0x' || substring(md5({member}), 1, 8))::BIGINT % CAST(ceil({n} / {PART_ROWS}.0) AS BIGINT) AS INTEGER) ELSE 0 END"


CODE = "('Function', 'Method')"
simple("function_calls", lambda n, e: graph.function_calls(n, e, NS), G + f"SELECT src_name AS caller, dst_name AS callee, src_id AS caller_id, dst_id AS callee_id, coalesce(call_count, 1) AS call_count, coalesce(is_recursive, false) AS is_recursive FROM X WHERE type = 'CALLS' AND src_namespace = '{NS}' AND src_label IN {CODE} AND dst_label IN {CODE}")
simple("class_hierarchy", graph.class_hierarchy, GR + """, T AS (SELECT src AS class_id, dst AS ancestor_id, 1 AS depth, src || '/' || dst AS path, [src || dst] AS trail FROM E WHERE type = 'INHERITS_FROM'
  UNION ALL SELECT T.class_id, E.dst, T.depth + 1, T.path || '/' || E.dst, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.ancestor_id AND E.type = 'INHERITS_FROM' WHERE NOT list_contains(T.trail, E.src || E.dst)) SELECT class_id, ancestor_id, depth, path FROM T""")
simple("module_dependencies", graph.module_dependencies, G + f", Z AS (SELECT *, {_part('src_id', 'dst_id')} AS part FROM X WHERE type = 'IMPORTS') " + "SELECT src_id AS module_id, part, max(src_name) AS module, count(*) AS n_imports, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS imports, coalesce(array_to_string(list_sort(list(DISTINCT import_type) FILTER (import_type IS NOT NULL)), ','), '') AS import_types FROM Z GROUP BY src_id, part")
simple("function_context", graph.function_context, G + f"""SELECT N.id, N.name, coalesce(a.callees, '') AS callees, coalesce(b.n_callers, 0) AS n_callers, coalesce(c.parents, '') AS parents FROM N
  LEFT JOIN (SELECT src_id AS id, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS callees FROM X WHERE type = 'CALLS' GROUP BY src_id) a ON a.id = N.id
  LEFT JOIN (SELECT dst_id AS id, count(DISTINCT src_id) AS n_callers FROM X WHERE type = 'CALLS' GROUP BY dst_id) b ON b.id = N.id
  LEFT JOIN (SELECT dst_id AS id, array_to_string(list_sort(list(DISTINCT src_name)), ',') AS parents FROM X WHERE type = 'CONTAINS' AND src_label = 'Class' GROUP BY dst_id) c ON c.id = N.id WHERE N.label IN {CODE}""")

LISTS = f"""FC AS (SELECT N.id, N.name, 0 AS part, coalesce(a.c, '') AS callees, coalesce(b.c, '') AS callers, coalesce(p.c, '') AS parents, coalesce(b.k, 0) AS n_callers FROM N
  LEFT JOIN (SELECT src_id AS id, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS c FROM X WHERE type = 'CALLS' GROUP BY 1) a ON a.id = N.id
  LEFT JOIN (SELECT dst_id AS id, array_to_string(list_sort(list(DISTINCT src_name)), ',') AS c, count(DISTINCT src_id) AS k FROM X WHERE type = 'CALLS' GROUP BY 1) b ON b.id = N.id
  LEFT JOIN (SELECT dst_id AS id, array_to_string(list_sort(list(DISTINCT src_name)), ',') AS c FROM X WHERE type = 'CONTAINS' AND src_label = 'Class' GROUP BY 1) p ON p.id = N.id WHERE N.label IN {CODE})"""
simple("function_lists", graph.function_lists, G + f", {LISTS} SELECT * FROM FC")


def _grouped(kind: str, direction: str) -> str:
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return G + f", Z AS (SELECT *, {_part(f'{a}_id', f'{b}_id')} AS part FROM X WHERE type = '{kind}') SELECT {a}_id AS id, {a}_name AS name, part, count(DISTINCT {b}_id) AS n, array_to_string(list_sort(list(DISTINCT {b}_name)), ',') AS others FROM Z GROUP BY ALL"


for _name, _kind, _dir in (
    ("step_parallel", "PARALLEL_WITH", "out"), ("step_dependencies", "DEPENDS_ON", "out"), ("step_dependents", "DEPENDS_ON", "in"), ("related_documents", "DOCUMENTS", "in"),
    ("documented_by", "DOCUMENTS", "out"), ("next_steps", "NEXT_STEP", "out"), ("belonging_steps", "BELONGS_TO", "in"), ("inheritors", "INHERITS_FROM", "in"), ("class_structure", "CONTAINS", "out"),
):
    simple(_name, lambda n, e, k=_kind, r=_dir: graph.grouped_neighbours(n, e, k, r), _grouped(_kind, _dir))
simple("steps_without_parallel", lambda n, e: graph.without_edge(n, e, "PARALLEL_WITH", ("Step",)), G + "SELECT id, name, namespace FROM N WHERE label = 'Step' AND id NOT IN (SELECT src FROM E WHERE type = 'PARALLEL_WITH')")
simple("leaf_functions", lambda n, e: graph.without_edge(n, e, "CALLS", graph.CODE), G + f"SELECT id, name, namespace FROM N WHERE label IN {CODE} AND id NOT IN (SELECT src FROM E WHERE type = 'CALLS')")
simple("isolated_functions", lambda n, e: graph.without_edge(n, e, "CALLS", graph.CODE, True, True), G + f"SELECT id, name, namespace FROM N WHERE label IN {CODE} AND id NOT IN (SELECT src FROM E WHERE type = 'CALLS') AND id NOT IN (SELECT dst FROM E WHERE type = 'CALLS')")
simple("document_sections", lambda n, e: graph.ordered_children(n, e, "HAS_SECTION"), G + "SELECT src_id AS parent_id, row_number() OVER (PARTITION BY src_id ORDER BY order_no NULLS LAST, dst_id) AS place, dst_id AS child_id, dst_name AS child FROM X WHERE type = 'HAS_SECTION'")
simple("ordered_contents", lambda n, e: graph.ordered_children(n, e, "CONTAINS"), G + "SELECT src_id AS parent_id, row_number() OVER (PARTITION BY src_id ORDER BY order_no NULLS LAST, dst_id) AS place, dst_id AS child_id, dst_name AS child FROM X WHERE type = 'CONTAINS'")
simple("search_by_name", lambda n, e: graph.search_by_name(n, NS, "Merge", 20), f"WITH {N} SELECT id, name, label FROM N WHERE namespace = '{NS}' AND contains(lower(name), 'merge') ORDER BY name, id LIMIT 20")
simple("search_any_word", lambda n, e: graph.search_any(n, WORDS), f"WITH {N} SELECT id, name, namespace FROM N WHERE " + " OR ".join(f"contains(lower(name), '{w}')" for w in WORDS))
simple("nodes_by_path", lambda n, e: n.groupBy("namespace", "file_path").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")), f"WITH {N} SELECT namespace, file_path, count(*) AS nodes, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM N GROUP BY ALL")
simple("namespace_stats", lambda n, e: graph.namespace_stats(n), f"WITH {N} SELECT namespace, label, count(*) AS nodes FROM N GROUP BY ALL")
simple("graph_stats", graph.graph_stats, G + "SELECT a.namespace, a.nodes, coalesce(b.edges, 0) AS edges FROM (SELECT namespace, count(*) AS nodes FROM N GROUP BY 1) a LEFT JOIN (SELECT N.namespace, count(*) AS edges FROM E JOIN N ON N.id = E.src GROUP BY 1) b ON a.namespace IS NOT DISTINCT FROM b.namespace")
for _name, _kind, _dir in (("most_called", "CALLS", "in"), ("most_calling", "CALLS", "out"), ("module_coupling", "IMPORTS", "out"), ("most_used", "USES", "in")):
    _side = "dst" if _dir == "in" else "src"
    simple(_name, lambda n, e, k=_kind, r=_dir: graph.degree_top(n, e, k, r, 25), G + f"SELECT N.id, N.name, count(*) AS degree FROM E JOIN N ON N.id = E.{_side} WHERE type = '{_kind}' GROUP BY ALL ORDER BY degree DESC, N.id LIMIT 25")
simple("most_complex", lambda n, e: graph.most_complex(n, 25), f"WITH {N} SELECT id, name, complexity FROM N WHERE label IN {CODE} AND complexity IS NOT NULL ORDER BY complexity DESC, id LIMIT 25")


def _starts(n: DataFrame) -> DataFrame:
    return n.where(F.col("label").isin(*graph.CODE) & (F.col("namespace") == NS) & F.contains(F.lower("name"), F.lit("merge"))).select(F.col("id").alias("start"))


_ST = f"ST AS (SELECT id AS start FROM N WHERE label IN {CODE} AND namespace = '{NS}' AND contains(lower(name), 'merge'))"


def _trails(depth: int, kind: str = "CALLS") -> str:
    return f"""{GR}, {_ST}, T AS (SELECT start, E.dst AS node, 1 AS depth, start || '/' || E.dst AS path, [E.src || E.dst] AS trail FROM ST JOIN E ON E.src = ST.start AND E.type = '{kind}'
  UNION ALL SELECT T.start, E.dst, T.depth + 1, T.path || '/' || E.dst, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.node AND E.type = '{kind}' WHERE T.depth < {depth} AND NOT list_contains(T.trail, E.src || E.dst)) """


simple("call_chains", lambda n, e: graph.call_chains(n, e, _starts(n), 3), _trails(3) + "SELECT T.start, T.node, N.name AS end_name, T.depth, T.path FROM T JOIN N ON N.id = T.node")
simple("call_chains_to_functions", lambda n, e: graph.call_chains(n, e, _starts(n), 4, F.col("end_label").isin(*graph.CODE)), _trails(4) + f"SELECT T.start, T.node, N.name AS end_name, T.depth, T.path FROM T JOIN N ON N.id = T.node WHERE N.label IN {CODE}")


def _leaf_chains(n: DataFrame, e: DataFrame) -> DataFrame:
    leaves = graph.without_edge(n, e, "CALLS", (*graph.CODE, "Symbol")).select(F.col("id").alias("node"))
    return graph.call_chains(n, e, _starts(n), 4).join(leaves, "node", "left_semi").select("start", "node", "depth", "path")


simple("leaf_chains", _leaf_chains, _trails(4) + "SELECT T.start, T.node, T.depth, T.path FROM T JOIN N ON N.id = T.node WHERE N.label IN ('Function', 'Method', 'Symbol') AND T.node NOT IN (SELECT src FROM E WHERE type = 'CALLS')")


def _chain_limit(n: DataFrame, e: DataFrame) -> DataFrame:
    w = Window.partitionBy("start").orderBy("depth", "path")
    return graph.call_chains(n, e, _starts(n), 2).withColumn("place", F.row_number().over(w)).where("place <= 5").select("start", "node", "depth", "path", "place")


simple("first_chains", _chain_limit, _trails(2) + ", R AS (SELECT start, node, depth, path, row_number() OVER (PARTITION BY start ORDER BY depth, path) AS place FROM T JOIN N ON N.id = T.node) SELECT * FROM R WHERE place <= 5")


def _reach_sql(depth: int, back: bool, both: bool = False, kind: str = "CALLS", st: str = _ST) -> str:
    hop = f"SELECT src AS a, dst AS b FROM E WHERE type = '{kind}'" if kind else "SELECT src AS a, dst AS b FROM E"
    h = f"SELECT b AS a, a AS b FROM ({hop})" if back else hop
    h = f"{hop} UNION SELECT b, a FROM ({hop})" if both else h
    return f"{GR}, {st}, H AS (SELECT DISTINCT a, b FROM ({h})), R AS (SELECT start, start AS node, 0 AS depth FROM ST UNION SELECT R.start, H.b, R.depth + 1 FROM R JOIN H ON H.a = R.node WHERE R.depth < {depth}), M AS (SELECT start, node, min(depth) AS depth FROM R GROUP BY ALL) "


simple("impact", lambda n, e: graph.impact(e.where("type = 'CALLS'"), _starts(n), 4), _reach_sql(4, True) + "SELECT start AS target, node, depth AS distance FROM M WHERE depth > 0")
simple("impact_all", lambda n, e: graph.impact(e, _starts(n), 5), _reach_sql(5, True, kind="") + "SELECT start AS target, node, depth AS distance FROM M WHERE depth > 0")
simple("reachable", lambda n, e: expand.reach(e.where("type = 'CALLS'"), _starts(n), 3).select("start", "node", "depth"), _reach_sql(3, False) + "SELECT * FROM M")
_HIER = "type in ('INHERITS_FROM', 'HAS_SECTION', 'DOCUMENTS')"
simple("neighbours", lambda n, e: expand.reach(e.where("type = 'DEPENDS_ON'"), e.where("type = 'DEPENDS_ON'").select(F.col("src").alias("start")).distinct(), 2, "both").where("depth > 0").select("start", "node", "depth"),
       GR + ", H AS (SELECT src AS a, dst AS b FROM E WHERE type = 'DEPENDS_ON' UNION SELECT dst, src FROM E WHERE type = 'DEPENDS_ON'), R AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM E WHERE type = 'DEPENDS_ON' UNION SELECT R.start, H.b, R.depth + 1 FROM R JOIN H ON H.a = R.node WHERE R.depth < 2) SELECT start, node, min(depth) AS depth FROM R GROUP BY ALL HAVING min(depth) > 0")


def _paths(n: DataFrame, e: DataFrame) -> DataFrame:
    h = e.where("type = 'NEXT_STEP'")
    first = h.select(F.col("src").alias("start")).distinct()
    pairs = expand.reach(h, first, 4, "out").where("depth >= 2").select("start", F.col("node").alias("target"))
    return expand.shortest_paths(h, pairs, 4).select("start", "target", "depth", F.array_join("path", "/").alias("path"))


simple("shortest_paths", _paths, None)


def _subgraph(n: DataFrame, e: DataFrame) -> DataFrame:
    h = e.where(_HIER)
    t = expand.trails(h, h.where("type = 'INHERITS_FROM'").select(F.col("dst").alias("start")).distinct(), 2, "in")
    return t.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.count("*").alias("trails"))


simple("subgraph", _subgraph, GR + f""", H AS (SELECT dst AS a, src AS b, src || dst || type AS k FROM E WHERE {_HIER}), T AS (SELECT DISTINCT dst AS start, dst AS node, 0 AS depth, CAST([] AS VARCHAR[]) AS trail FROM E WHERE type = 'INHERITS_FROM'
  UNION ALL SELECT T.start, H.b, T.depth + 1, list_append(T.trail, H.k) FROM T JOIN H ON H.a = T.node WHERE T.depth < 2 AND NOT list_contains(T.trail, H.k)) SELECT start, node, min(depth) AS depth, count(*) AS trails FROM T WHERE depth > 0 GROUP BY ALL""")
_FROM = "SELECT DISTINCT dst AS start, dst AS node, 0 AS depth, CAST([] AS VARCHAR[]) AS types, CAST([] AS VARCHAR[]) AS trail FROM E WHERE type = 'INHERITS_FROM'"
simple("subgraph_all", lambda n, e: expand.subgraph(e, e.where("type = 'INHERITS_FROM'").select(F.col("dst").alias("start")).distinct(), 2), GR + f""", H AS (SELECT src AS a, dst AS b, src || dst || type AS k, type FROM E UNION ALL SELECT dst, src, src || dst || type, type FROM E WHERE src <> dst), T AS ({_FROM}
  UNION ALL SELECT T.start, H.b, T.depth + 1, list_append(T.types, H.type), list_append(T.trail, H.k) FROM T JOIN H ON H.a = T.node WHERE T.depth < 2 AND NOT list_contains(T.trail, H.k))
  SELECT start, node, min(depth) AS depth, count(*) AS trails, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types FROM T WHERE depth > 0 GROUP BY ALL""")
simple("relationships", lambda n, e: graph.relationships(n, e, n.where("label = 'Class'").select("id")), G + ", C AS (SELECT id FROM N WHERE label = 'Class'), R AS (SELECT src AS id, 'out' AS direction, type, dst AS other_id FROM E WHERE src IN (FROM C) UNION ALL SELECT dst, 'in', type, src FROM E WHERE dst IN (FROM C)) SELECT R.*, N.name AS other_name FROM R LEFT JOIN N ON N.id = R.other_id")


def _reverse(n: DataFrame, e: DataFrame) -> DataFrame:
    x = graph.ends(n, e, "CALLS").where(F.col("dst_label").isin(*graph.CODE))
    return x.groupBy(F.col("dst_name").alias("name")).agg(F.count_distinct("src_id").alias("callers"), F.count_distinct("src_file_path").alias("files"))


simple("reverse_calls", _reverse, G + f"SELECT dst_name AS name, count(DISTINCT src_id) AS callers, count(DISTINCT src_file_path) AS files FROM X WHERE type = 'CALLS' AND dst_label IN {CODE} GROUP BY 1")
simple("direct_calls_ordered", lambda n, e: graph.ends(n, e, "CALLS").where(F.col("src_namespace") == NS).select("src_name", "dst_name", "dst_file_path", "src_id", "dst_id").orderBy("src_name", "dst_name", "src_id", "dst_id"), G + f"SELECT src_name, dst_name, dst_file_path, src_id, dst_id FROM X WHERE type = 'CALLS' AND src_namespace = '{NS}'")
simple("calls_per_file", lambda n, e: graph.ends(n, e, "CALLS").groupBy(F.col("src_file_path").alias("file_path")).agg(F.count("*").alias("calls")), G + "SELECT src_file_path AS file_path, count(*) AS calls FROM X WHERE type = 'CALLS' GROUP BY 1")
_LAYER = "CASE WHEN {0} LIKE '%/api/%' OR {0} LIKE '%/channel/%' THEN 'api' WHEN {0} LIKE '%/worker/%' OR {0} LIKE '%/job/%' THEN 'worker' WHEN {0} LIKE '%/cart/%' OR {0} LIKE '%/ledger/%' THEN 'store' END"
simple("layer_counts", lambda n, e: n.groupBy(graph.layer_of("file_path").alias("layer")).agg(F.count("*").alias("nodes")), f"WITH {N} SELECT {_LAYER.format('file_path')} AS layer, count(*) AS nodes FROM N GROUP BY 1")
simple("layer_matrix", graph.layer_matrix, G + f", L AS (SELECT * FROM (VALUES ('api'), ('worker'), ('store')) v(l)) SELECT a.l AS from_layer, b.l AS to_layer, count(c.f) AS calls FROM L a CROSS JOIN L b LEFT JOIN (SELECT {_LAYER.format('src_file_path')} AS f, {_LAYER.format('dst_file_path')} AS t FROM X WHERE type = 'CALLS') c ON c.f = a.l AND c.t = b.l GROUP BY ALL")
simple("layer_chain", graph.layer_chain, G + f", L AS (SELECT id, {_LAYER.format('file_path')} AS layer FROM N) SELECT b.id AS mid, count(*) AS chains FROM E x JOIN L a ON a.id = x.src AND a.layer = 'api' JOIN L b ON b.id = x.dst AND b.layer = 'worker' JOIN E y ON y.src = b.id AND y.type = 'CALLS' JOIN L c ON c.id = y.dst AND c.layer = 'store' WHERE x.type = 'CALLS' GROUP BY 1")
simple("cross_namespace_calls", graph.cross_namespace, G + "SELECT src_namespace AS from_ns, dst_namespace AS to_ns, count(*) AS calls FROM X WHERE type = 'CALLS' AND src_namespace <> dst_namespace GROUP BY ALL")
simple("service_language_rollup", lambda n, e: graph.service_language(n), f"WITH {N} SELECT service, language, count(*) AS units FROM (SELECT split_part(namespace, ':', 2) AS service, coalesce(language, '?') AS language FROM N WHERE label IN {CODE}) GROUP BY ROLLUP (service, language)")
simple("completeness_by_service", graph.completeness, G + f"SELECT split_part(namespace, ':', 2) AS service, count(*) AS functions, count(c.src) AS with_calls FROM N LEFT JOIN (SELECT DISTINCT src FROM E WHERE type = 'CALLS') c ON c.src = N.id WHERE label IN {CODE} GROUP BY 1")
simple("distinct_services", lambda n, e: n.where(F.col("namespace").startswith("shopmesh:")).select(model.service().alias("service")).distinct(), f"WITH {N} SELECT DISTINCT split_part(namespace, ':', 2) AS service FROM N WHERE starts_with(namespace, 'shopmesh:')")
simple("missing_services", lambda n, e: e.sparkSession.createDataFrame([(x,) for x in ("gateway", "cart", "warehouse")], "service string").exceptAll(n.select(model.service().alias("service")).distinct()), f"WITH {N} SELECT * FROM (VALUES ('gateway'), ('cart'), ('warehouse')) v(service) EXCEPT SELECT split_part(namespace, ':', 2) FROM N")
simple("edge_types", lambda n, e: e.groupBy("type").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets")), f"WITH {E} SELECT type, count(*) AS edges, count(DISTINCT dst) AS targets FROM E GROUP BY 1")
simple("dependent_classes", lambda n, e: _dependent(n, e), G + """, K AS (SELECT src_id AS class_id, dst_id AS id FROM X WHERE type = 'CONTAINS' AND src_label = 'Class') SELECT a.class_id AS from_class, b.class_id AS to_class, count(*) AS calls FROM E JOIN K a ON a.id = E.src JOIN K b ON b.id = E.dst WHERE E.type = 'CALLS' AND a.class_id <> b.class_id GROUP BY ALL""")


def _dependent(n: DataFrame, e: DataFrame) -> DataFrame:
    k = graph.ends(n, e, "CONTAINS").where("src_label = 'Class'").select(F.col("src_id").alias("class_id"), F.col("dst_id").alias("id"))
    c = e.where("type = 'CALLS'").select("src", "dst")
    x = c.join(k.select(F.col("id").alias("src"), F.col("class_id").alias("from_class")), "src").join(k.select(F.col("id").alias("dst"), F.col("class_id").alias("to_class")), "dst")
    return x.where("from_class <> to_class").groupBy("from_class", "to_class").agg(F.count("*").alias("calls"))


# Units: containment, calls, imports, ids, embeddings' texts, detection.
def unit_query(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    q(name, sql)(lambda s, d: f(model.units(s, d)))


for _strict in (False, True):
    unit_query("containment_strict" if _strict else "containment", lambda u, st=_strict: graph.containment(u, st), f"""WITH {U} SELECT p.id AS parent_id, c.id AS child_id, p.type AS parent_type FROM U p JOIN U c ON c.namespace = p.namespace AND c.file_path = p.file_path
      WHERE (p.type = 'Module' AND c.type IN ('Class', 'Function')) OR (p.type = 'Class' AND c.type = 'Method' AND c.line_start > p.line_start AND c.line_end {'<' if _strict else '<='} p.line_end)""")
_CALLS = f"""WITH {U}, C AS (SELECT DISTINCT id AS src, namespace, call FROM (SELECT id, namespace, unnest(calls) AS call FROM U WHERE type IN {CODE}) WHERE call IS NOT NULL),
 T AS (SELECT namespace, name, min(id) AS dst FROM U WHERE type IN {CODE} GROUP BY ALL),
 D AS (SELECT C.src, coalesce(a.dst, b.dst) AS dst FROM C LEFT JOIN T a ON a.namespace = C.namespace AND a.name = C.call LEFT JOIN T b ON b.namespace = C.namespace AND b.name = split_part(C.call, '.', 2)
   AND len(string_split(C.call, '.')) = 2 AND split_part(C.call, '.', 1) IN ('s', 'ctx', 'w', 'r', 'logger', 'client')) """
unit_query("call_resolution", graph.resolve_calls, _CALLS + "SELECT src, dst, count(*) AS call_count FROM D WHERE dst IS NOT NULL GROUP BY ALL")
unit_query("import_edges", graph.import_edges, f"WITH {U}, M AS (SELECT * FROM U WHERE type = 'Module'), I AS (SELECT id AS src, namespace, unnest(imports) AS i FROM M), T AS (SELECT namespace, name, min(id) AS dst FROM M GROUP BY ALL) SELECT DISTINCT src, dst FROM I JOIN T ON T.namespace = I.namespace AND T.name = string_split_regex(i, '[./]')[-1] WHERE src <> dst")
q("conversion_rate", f"WITH {U}, {E} SELECT namespace, CAST(sum(coalesce(len(calls), 0)) AS BIGINT) AS listed, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS edges, round(sum(coalesce(c.n, 0)) / nullif(sum(coalesce(len(calls), 0)), 0), 4) AS rate FROM U LEFT JOIN (SELECT src, count(*) AS n FROM E WHERE type = 'CALLS' GROUP BY 1) c ON c.src = U.id GROUP BY 1")(lambda s, d: graph.conversion(model.units(s, d), model.edges(s, d)))
unit_query("unit_ids", lambda u: u.select("id", model.unit_id(F.col("file_path"), F.col("line_start"), F.col("name")).alias("derived_id")), f"WITH {U} SELECT id, substring(sha256(file_path || ':' || line_start || ':' || name), 1, 16) AS derived_id FROM U")
unit_query("point_ids", lambda u: u.select("id", model.point_id(F.col("id")).alias("point_id")), f"WITH {U}, P AS (SELECT id, CASE WHEN regexp_full_match(replace(id, '-', ''), '[0-9a-fA-F]*') THEN rpad(substring(replace(id, '-', ''), 1, 32), 32, '0') ELSE md5(id) END AS h FROM U) SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS point_id FROM P")
unit_query("unit_texts", lambda u: u.select("id", F.md5(vector.unit_text()).alias("text_md5")), f"WITH {U} SELECT id, md5(concat_ws(chr(10), nullif(signature, ''), nullif(docstring, ''), nullif(substring(code, 1, 500), ''))) AS text_md5 FROM U")
unit_query("hash_embeddings", lambda u: u.select("id", vector.hash_embedding(vector.unit_text()).alias("e")).select("id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("e").alias("dims")), None)
unit_query("duplicate_units", lambda u: u.groupBy("namespace", "name").agg(F.count("*").alias("units")).where("units > 1"), f"WITH {U} SELECT namespace, name, count(*) AS units FROM U GROUP BY ALL HAVING count(*) > 1")
q("repeated_ids", f"SELECT lower(trim(id, {_B})) AS id, count(*) AS rows FROM code_unit GROUP BY 1 HAVING count(*) > 1")(lambda s, d: graph.duplicates(table(s, d, "code_unit").select(norm_id("id").alias("id"))))


def _case(choices: list[tuple[str, list[str]]], expr: str, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({expr}), '{w.lower()}')" for w in words) + f" THEN '{k}'" for k, words in choices) + f" ELSE {default} END"


def _entry_sql() -> str:
    out = "CASE"
    for lang, types in detect.ENTRY_WORDS.items():
        for kind, words in types:
            hit = " OR ".join(f"coalesce(contains(lower(name), '{w.lower()}'), false) OR coalesce(contains(code, '{w}'), false) OR coalesce(contains(signature, '{w}'), false)" for w in words)
            out += f" WHEN lower(trim(language)) = '{lang}' AND ({hit}) THEN '{kind}'"
    return out + " END"


unit_query("function_roles", lambda u: u.where(F.col("type").isin(*graph.CODE)).select("id", "name", detect.role(F.col("name")).alias("role")), f"WITH {U} SELECT id, name, {_case(detect.ROLE_WORDS, 'name', chr(39) + 'processing' + chr(39))} AS role FROM U WHERE type IN {CODE}")
unit_query("role_histogram", lambda u: u.where(F.col("type").isin(*graph.CODE)).groupBy(detect.role(F.col("name")).alias("role")).agg(F.count("*").alias("functions")), f"WITH {U} SELECT {_case(detect.ROLE_WORDS, 'name', chr(39) + 'processing' + chr(39))} AS role, count(*) AS functions FROM U WHERE type IN {CODE} GROUP BY 1")
unit_query("entry_points", lambda u: u.where(F.col("type").isin(*graph.CODE)).select("id", "name", "namespace", detect.entry_point().alias("entry_type")).where("entry_type is not null"), f"WITH {U}, P AS (SELECT id, name, namespace, {_entry_sql()} AS entry_type FROM U WHERE type IN {CODE}) SELECT * FROM P WHERE entry_type IS NOT NULL")
unit_query("entry_points_grouped", lambda u: u.where(F.col("type").isin(*graph.CODE)).select(model.service().alias("service"), detect.entry_point().alias("entry_type")).where("entry_type is not null").groupBy("service", "entry_type").agg(F.count("*").alias("entries")), f"WITH {U}, P AS (SELECT split_part(namespace, ':', 2) AS service, {_entry_sql()} AS entry_type FROM U WHERE type IN {CODE}) SELECT service, entry_type, count(*) AS entries FROM P WHERE entry_type IS NOT NULL GROUP BY ALL")
unit_query("call_kinds", lambda u: u.select(F.explode("calls").alias("call")).groupBy(detect.call_kind(F.col("call")).alias("kind")).agg(F.count("*").alias("calls")), f"WITH {U}, C AS (SELECT unnest(calls) AS call FROM U) SELECT {_case(detect.CALL_WORDS, 'call', chr(39) + 'processing' + chr(39))} AS kind, count(*) AS calls FROM C GROUP BY 1")
unit_query("http_methods_loose", lambda u: u.groupBy(detect.http_method_loose(F.col("code")).alias("method")).agg(F.count("*").alias("units")), f"WITH {U} SELECT {_case([(v, [v]) for v in ('GET', 'POST', 'PUT', 'DELETE', 'PATCH')], 'code', 'NULL')} AS method, count(*) AS units FROM U GROUP BY 1")
unit_query("http_verb_usage", lambda u: u.groupBy("namespace").agg(*[F.count_if(F.contains(F.lower("code"), F.lit(v))).alias(v) for v in ("get", "post", "put", "delete")]), f"WITH {U} SELECT namespace, " + ", ".join(f"count(*) FILTER (contains(lower(code), '{v}')) AS \"{v}\"" for v in ("get", "post", "put", "delete")) + " FROM U GROUP BY 1")
unit_query("expected_calls", lambda u: u.select("id", F.explode(F.regexp_extract_all("code", F.lit(r"s\.(\w+)\("), 1)).alias("call"), "calls").select("id", "call", F.coalesce(F.exists("calls", lambda c: F.split_part(c, F.lit("."), F.lit(-1)) == F.col("call")), F.lit(False)).alias("listed")).groupBy("listed").agg(F.count("*").alias("mentions")), f"WITH {U}, C AS (SELECT id, unnest(regexp_extract_all(code, 's\\.([a-zA-Z0-9_]+)\\(', 1)) AS call, calls FROM U) SELECT coalesce(len(list_filter(calls, lambda c: split_part(c, '.', -1) = call)) > 0, false) AS listed, count(*) AS mentions FROM C GROUP BY 1")
unit_query("formatted_code", lambda u: u.select("id", F.md5(context.format_code()).alias("content_md5")), None)
q("http_endpoints", None)(lambda s, d: detect.http_endpoints(table(s, d, "source_file").select("file_id", language_of(F.col("file_path")).alias("language"), "code"), "file_id"))
q("line_counts", "SELECT file_id, len(string_split(code, chr(10))) AS total_lines, len(list_filter(string_split(code, chr(10)), lambda x: trim(x, E' \\t\\r\\f\\x0b') <> '' AND NOT regexp_matches(trim(x, E' \\t\\r\\f\\x0b'), '^(#|//|/\\*|\\*)'))) AS code_lines FROM source_file")(lambda s, d: table(s, d, "source_file").select("file_id", text.line_counts(F.col("code"))[0].alias("total_lines"), text.line_counts(F.col("code"))[1].alias("code_lines")))


def _merged(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "graph_node").select(norm_id("id").alias("id"), "name", "namespace")
    new = table(s, d, "deleted_node").select(norm_id("node_id").alias("id"), "name", "namespace")
    return graph.merge_nodes(old, new, ["id"])


q("merge_nodes", f"WITH O AS (SELECT lower(trim(id, {_B})) AS id, name, namespace FROM graph_node), W AS (SELECT lower(trim(node_id, {_B})) AS id, max(name) AS name, max(namespace) AS namespace FROM deleted_node GROUP BY 1) SELECT coalesce(W.id, O.id) AS id, coalesce(W.name, O.name) AS name, coalesce(W.namespace, O.namespace) AS namespace FROM O FULL JOIN W ON W.id = O.id")(_merged)
simple("delete_namespace", lambda n, e: graph.delete_namespace(n, e, NS)[1].groupBy("type").agg(F.count("*").alias("edges")), G + f"SELECT type, count(*) AS edges FROM E WHERE src NOT IN (SELECT id FROM N WHERE namespace = '{NS}') AND dst NOT IN (SELECT id FROM N WHERE namespace = '{NS}') GROUP BY 1")
simple("merge_edges", lambda n, e: graph.merge_edges(e.where("type <> 'CALLS'"), e.where("type = 'CALLS'"), n).groupBy("type").agg(F.count("*").alias("edges")), G + "SELECT type, count(*) AS edges FROM E WHERE type <> 'CALLS' OR (src IN (SELECT id FROM N) AND dst IN (SELECT id FROM N)) GROUP BY 1")
simple("entry_flows", lambda n, e: detect.flows(n, e, _starts(n), 4), _reach_sql(4, False) + "SELECT start, count(*) AS node_count, max(depth) AS max_depth FROM M GROUP BY 1")
simple("flow_summary", lambda n, e: detect.flows(n, e, _starts(n), 4).agg(F.count("*").alias("flows"), F.sum("node_count").alias("functions"), F.round(F.avg("max_depth"), 6).alias("mean_depth"), F.max("max_depth").alias("deepest")), _reach_sql(4, False) + "SELECT count(*) AS flows, CAST(sum(c) AS BIGINT) AS functions, round(avg(m), 6) AS mean_depth, max(m) AS deepest FROM (SELECT count(*) AS c, max(depth) AS m FROM M GROUP BY start)")

# D5, A22, D6 over all entries of D1, to the depth of the reference: functions at depth 10 are not entered.
FLOW_DEPTH = 9


def entry_starts(s: SparkSession, d: str) -> DataFrame:
    return model.units(s, d).where(F.col("type").isin(*graph.CODE) & detect.entry_point().isNotNull()).select(F.col("id").alias("start"))


_ALL = _reach_sql(FLOW_DEPTH, False, st=f"{U}, ST AS (SELECT id AS start FROM U WHERE type IN {CODE} AND ({_entry_sql()}) IS NOT NULL)")
q("all_entry_flows", _ALL + "SELECT start, count(*) AS node_count, max(depth) AS max_depth FROM M GROUP BY 1")(lambda s, d: detect.flows(model.nodes(s, d), model.edges(s, d), entry_starts(s, d), FLOW_DEPTH))
q("all_flow_summary", _ALL + "SELECT count(*) AS flows, CAST(sum(c) AS BIGINT) AS functions, round(avg(m), 6) AS mean_depth, max(m) AS deepest FROM (SELECT count(*) AS c, max(depth) AS m FROM M GROUP BY start)")(lambda s, d: detect.flows(model.nodes(s, d), model.edges(s, d), entry_starts(s, d), FLOW_DEPTH).agg(F.count("*").alias("flows"), F.sum("node_count").alias("functions"), F.round(F.avg("max_depth"), 6).alias("mean_depth"), F.max("max_depth").alias("deepest")))
q("all_flow_outline", _ALL + "SELECT M.start, M.node, M.depth, repeat('  ', M.depth) || '- ' || N.name AS line FROM M JOIN N ON N.id = M.node")(lambda s, d: detect.outline(expand.reach(model.edges(s, d).where("type = 'CALLS'"), entry_starts(s, d), FLOW_DEPTH), model.nodes(s, d)))

q("request_flows", None)(lambda s, d: detect.request_flows(model.units(s, d).withColumn("language", language_of(F.col("file_path")))))
simple("root_leaf_paths", lambda n, e: graph.root_leaf_paths(e, "NEXT_STEP"), None)
_STEP = [("dependencies", "src", "dst", "DEPENDS_ON", "Step"), ("parallel_steps", "src", "dst", "PARALLEL_WITH", "Step"), ("next_steps", "dst", "src", "DEPENDS_ON", "Step"), ("phases", "dst", "src", "CONTAINS", "Phase")]
simple("step_neighbourhood", graph.step_neighbourhood, G + "SELECT N.id, N.name, 0 AS part, " + ", ".join(f"coalesce({k}.c, '') AS {k}" for k, *_ in _STEP) + " FROM N " + " ".join(f"LEFT JOIN (SELECT {a}_id AS id, array_to_string(list_sort(list(DISTINCT {b}_name)), ',') AS c FROM X WHERE type = '{t}' AND {b}_label = '{lab}' GROUP BY 1) {k} ON {k}.id = N.id" for k, a, b, t, lab in _STEP) + " WHERE N.label = 'Step'")


# Vectors.
def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _query(s: SparkSession, d: str) -> list[float]:
    return list(_vectors(s, d).where("vec_id = 0").select("embedding").first()[0])


_SC = "V AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings)"
q("vector_top", f"WITH {_SC} SELECT * FROM V ORDER BY score DESC, vec_id LIMIT 10")(lambda s, d: vector.search(_vectors(s, d), _query(s, d), 10))
q("vector_top_filtered", f"WITH {_SC} SELECT * FROM V WHERE label = 3 AND score >= 0.0 ORDER BY score DESC, vec_id LIMIT 10")(lambda s, d: vector.search(_vectors(s, d), _query(s, d), 10, F.col("label") == 3, 0.0))
q("vector_fanout", f"WITH {_SC}, R AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM V) SELECT vec_id, label, score FROM R WHERE r <= 5 ORDER BY score DESC, vec_id LIMIT 10")(lambda s, d: vector.fanout(_vectors(s, d), _query(s, d), 5, 10))
q("vector_relevance", f"WITH {_SC} SELECT CASE WHEN score > 0.5 THEN 'high' ELSE 'medium' END AS relevance, count(*) AS hits FROM V GROUP BY 1")(lambda s, d: vector.scored(_vectors(s, d), _query(s, d)).groupBy(vector.relevance().alias("relevance")).agg(F.count("*").alias("hits")))
q("vector_graph_filter", f"WITH {_SC} SELECT V.* FROM V WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'atlas-wiki') ORDER BY score DESC, vec_id LIMIT 10")(lambda s, d: vector.search(_vectors(s, d).join(table(s, d, "documents").where("source = 'atlas-wiki'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), _query(s, d), 10))
q("vector_expand", f"WITH {_SC} SELECT V.vec_id, V.score, d.source, d.doc_type FROM (SELECT * FROM V ORDER BY score DESC, vec_id LIMIT 25) V JOIN documents d ON d.doc_id = V.vec_id")(lambda s, d: vector.search(_vectors(s, d), _query(s, d), 25).join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "doc_type"), "vec_id").select("vec_id", "score", "source", "doc_type"))
q("vector_knn", "WITH P AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0), R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM P) SELECT * FROM R WHERE rank <= 5")(lambda s, d: vector.knn(_vectors(s, d), _vectors(s, d).where("vec_id % 50 = 0"), 5))
q("collection_info", "SELECT label, count(*) AS points, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM embeddings GROUP BY 1")(lambda s, d: _vectors(s, d).groupBy("label").agg(F.count("*").alias("points"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim")))


# Context.
_FIRST = "D AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substring(content, 1, 200) ORDER BY item_id) AS r FROM context_item WHERE content IS NOT NULL) WHERE r = 1), K AS (SELECT *, least(1.0, greatest(0.0, coalesce(relevance_score, 0.0))) AS score FROM D), L AS (SELECT *, CAST(floor(length(content) / 4) AS BIGINT) AS tokens FROM K WHERE score > 0.3), W AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM L)"
q("context_dedupe", f"WITH {_FIRST} SELECT query_id, item_id FROM D")(lambda s, d: context.dedupe(table(s, d, "context_item")).select("query_id", "item_id"))
q("context_ranked", f"WITH {_FIRST} SELECT query_id, item_id, score FROM L")(lambda s, d: context.ranked(context.dedupe(table(s, d, "context_item"))).select("query_id", "item_id", "score"))
q("context_budget", f"WITH {_FIRST} SELECT query_id, item_id, tokens, running FROM W WHERE running <= 1000")(lambda s, d: context.within_budget(context.ranked(context.dedupe(table(s, d, "context_item"))), 1000).select("query_id", "item_id", "tokens", "running"))
q("context_summary", f"""WITH {_FIRST}, C AS (SELECT query_id, count(*) FILTER (lower(trim(source_type)) = 'code') AS c, count(*) FILTER (lower(trim(source_type)) = 'document') AS o, count(*) FILTER (lower(trim(source_type)) = 'graph') AS g FROM W WHERE running <= 1000 GROUP BY 1)
  SELECT query_id, 'Retrieved ' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' code units' END, CASE WHEN o > 0 THEN o || ' document chunks' END, CASE WHEN g > 0 THEN g || ' graph analyses' END) AS summary FROM C""")(lambda s, d: context.summary(context.within_budget(context.ranked(context.dedupe(table(s, d, "context_item"))), 1000)))


# Flows.
def flow_query(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        st = model.steps(s, d)
        return f(st, model.parallel_pairs(st))

    q(name, sql)(run)


_GROUPS = "GA AS (SELECT flow_id, members FROM (SELECT flow_id, list_sort(list(step)) AS members FROM S GROUP BY flow_id, array_to_string(list_sort(depends_on), ',')) WHERE len(members) > 1), GB AS (SELECT flow_id, list_sort(list_distinct(list_append(list(DISTINCT other), step))) AS members FROM PP GROUP BY flow_id, step), GG AS (SELECT DISTINCT * FROM (SELECT * FROM GA UNION ALL SELECT * FROM GB))"
flow_query("flow_dependencies", lambda s, p: s.select("flow_id", "step", F.array_join("depends_on", ",").alias("deps")), FL + "SELECT flow_id, step, coalesce(array_to_string(depends_on, ','), '') AS deps FROM S")
flow_query("flow_same_dependencies", lambda s, p: flow.same_dependency_groups(s).drop("members"), FL + "SELECT flow_id, coalesce(array_to_string(list_sort(depends_on), ','), '') AS deps, array_to_string(list_sort(list(step)), ',') AS steps, count(*) AS n FROM S GROUP BY flow_id, coalesce(array_to_string(list_sort(depends_on), ','), '') HAVING count(*) > 1")
flow_query("flow_parallel_steps", flow.parallel_with, FL + "SELECT flow_id, step, array_to_string(list_sort(list(DISTINCT other)), ',') AS others FROM PP GROUP BY ALL")
flow_query("flow_groups", lambda s, p: flow.all_groups(s, p).select("flow_id", F.array_join("members", ",").alias("members")), FL + f", {_GROUPS} SELECT flow_id, array_to_string(members, ',') AS members FROM GG")
flow_query("flow_speedup", lambda s, p: flow.speedup(s, flow.all_groups(s, p)), FL + f""", {_GROUPS}, GS AS (SELECT flow_id, members, sum(minutes) - max(minutes) AS sv FROM (SELECT GG.flow_id, members, S.minutes FROM (SELECT flow_id, members, unnest(members) AS step FROM GG) GG JOIN S ON S.flow_id = GG.flow_id AND S.step = GG.step) GROUP BY flow_id, members),
  SV AS (SELECT flow_id, sum(sv) AS saved FROM GS GROUP BY 1), TT AS (SELECT flow_id, sum(minutes) AS sequential FROM S GROUP BY 1), R AS (SELECT TT.flow_id, sequential, coalesce(saved, 0.0) AS saved FROM TT LEFT JOIN SV ON SV.flow_id = TT.flow_id)
  SELECT flow_id, sequential, saved, sequential - saved AS parallel, round(CASE WHEN sequential - saved > 0 THEN sequential / (sequential - saved) ELSE 1.0 END, 6) AS speedup FROM R""")
flow_query("flow_critical_time", lambda s, p: flow.critical_paths(s).select("flow_id", "critical_time"), f"""WITH RECURSIVE {S}, Q AS (SELECT flow_id, step, minutes AS f1, CAST(0 AS DOUBLE) AS f2, minutes AS best FROM S WHERE step = 1
  UNION ALL SELECT S.flow_id, S.step, S.minutes + CASE S.flag WHEN 'A' THEN Q.f1 WHEN 'R' THEN greatest(Q.f1, Q.f2) ELSE CAST(0 AS DOUBLE) END, Q.f1, greatest(Q.best, S.minutes + CASE S.flag WHEN 'A' THEN Q.f1 WHEN 'R' THEN greatest(Q.f1, Q.f2) ELSE CAST(0 AS DOUBLE) END) FROM Q JOIN S ON S.flow_id = Q.flow_id AND S.step = Q.step + 1) SELECT flow_id, max(best) AS critical_time FROM Q GROUP BY 1""")
flow_query("flow_critical_path", lambda s, p: flow.critical_paths(s), None)


def _advice(s: DataFrame, p: DataFrame) -> DataFrame:
    g = flow.all_groups(s, p)
    return flow.recommendations(flow.speedup(s, g), g, flow.critical_paths(s))


flow_query("flow_advice", _advice, None)
flow_query("flow_follows", lambda s, p: s.withColumn("prev", F.lag("step").over(Window.partitionBy("flow_id").orderBy("step"))).where("prev is not null and size(depends_on) = 0").select("flow_id", F.col("prev").alias("from_step"), F.col("step").alias("to_step")), FL + "SELECT flow_id, step - 1 AS from_step, step AS to_step FROM S WHERE step > 1 AND len(depends_on) = 0")


# Texts.
def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


_W = "E' \\t\\r\\n\\f\\x0b'"
_PARA = f"P AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {_W})), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)"
q("paragraphs", f"WITH {_PARA} SELECT doc_id, len(p) AS paragraphs, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS longest FROM P")(lambda s, d: _docs(s, d).where("text is not null").select("doc_id", text.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("paragraphs"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest")))
q("greedy_chunks", f"""WITH RECURSIVE {_PARA}, R AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM P),
  Q AS (SELECT doc_id, i, length(t) AS size, 0 AS chunk FROM R WHERE i = 1
  UNION ALL SELECT R.doc_id, R.i, CASE WHEN Q.size + length(R.t) > 600 THEN length(R.t) ELSE Q.size + length(R.t) END, CASE WHEN Q.size + length(R.t) > 600 THEN Q.chunk + 1 ELSE Q.chunk END FROM Q JOIN R ON R.doc_id = Q.doc_id AND R.i = Q.i + 1),
  C AS (SELECT Q.doc_id, Q.chunk AS chunk_index, string_agg(R.t, chr(10) || chr(10) ORDER BY R.i) AS content FROM Q JOIN R ON R.doc_id = Q.doc_id AND R.i = Q.i GROUP BY ALL)
  SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, length(content) AS char_count, md5(content) AS content_md5 FROM C""")(lambda s, d: text.chunk_rows(_docs(s, d), "doc_id", "text", 600).select("doc_id", "chunk_index", "total_chunks", "char_count", F.md5("content").alias("content_md5")))
q("overlapping_chunks", None)(lambda s, d: text.chunk_rows(_docs(s, d), "doc_id", "text", 600, 80).select("doc_id", "chunk_index", "total_chunks", "word_count", "char_count", F.md5("content").alias("content_md5")))
q("titles", f"WITH L AS (SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 3), lambda x: trim(x, {_W})), lambda x: starts_with(x, '#')) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, trim(regexp_replace(l[1], '^#+', ''), {_W}) AS title FROM L")(lambda s, d: _docs(s, d).where("text is not null").select("doc_id", text.title(F.col("text")).alias("title")))
q("heading_sections", f"""WITH T AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS p FROM documents WHERE text IS NOT NULL), R AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS section_no, unnest(p) AS part FROM T)
  SELECT doc_id, section_no, CASE WHEN section_no = 0 THEN 'Overview' ELSE trim(substring(part, 1, instr(part, chr(10)) - 1), {_W}) END AS heading, md5(trim(CASE WHEN section_no = 0 THEN part ELSE substring(part, instr(part, chr(10)) + 1) END, {_W})) AS body_md5 FROM R WHERE section_no = 0 OR contains(part, chr(10))""")(lambda s, d: text.sections(_docs(s, d), "doc_id", "text").select("doc_id", "section_no", "heading", F.md5("body").alias("body_md5")))
q("wrapped_lines", None)(lambda s, d: table(s, d, "code_unit").select("id", F.size(text.wrap(F.coalesce("docstring", F.lit("")))).alias("lines")))


def _intent_sql() -> str:
    out = "CASE"
    for name, _, _, _, pats in intent.INTENTS:
        out += " WHEN regexp_matches(lower(text), '" + "|".join(f"(?:{p})" for p in pats) + f"') THEN '{name}'"
    return out + " ELSE 'general_question' END"


def _intents(s: SparkSession, d: str) -> DataFrame:
    c = intent.classify(F.col("text"))
    return _docs(s, d).where("text is not null").select("doc_id", "text", *[v.alias(k) for k, v in c.items()])


q("intents", f"SELECT doc_id, {_intent_sql()} AS intent FROM documents WHERE text IS NOT NULL")(lambda s, d: _intents(s, d).select("doc_id", "intent"))
q("intent_needs", f"SELECT {_intent_sql()} AS intent, count(*) AS questions FROM documents WHERE text IS NOT NULL GROUP BY 1")(lambda s, d: _intents(s, d).groupBy("intent").agg(F.count("*").alias("questions")))
q("intent_entities", None)(lambda s, d: _intents(s, d).select("doc_id", "intent", "confidence", intent.entity_name(F.col("text"), F.col("intent")).alias("name"), intent.entity_path(F.col("text")).alias("file_path"), F.array_join(F.transform(intent.entity_numbers(F.col("text")), lambda x: x.cast("string")), ",").alias("numbers")))
q("formatted_documents", None)(lambda s, d: text.chunk_rows(_docs(s, d), "doc_id", "text", 1500).join(_docs(s, d).select("doc_id", "title", "source"), "doc_id").select("doc_id", "chunk_index", F.md5(context.format_document()).alias("content_md5")))
