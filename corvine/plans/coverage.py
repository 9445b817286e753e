"""Further look-ups, changes, formats and analyses of the graph's own flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine import model
from corvine.common import norm_id, table
from corvine.functions import text
from corvine.operators import context, detect, flow, graph, intent, retrieve, vector
from corvine.plans.core import _B, _ST, CODE, G, GR, LISTS, NS, E, N, U, _case, _starts
from corvine.plans.core import SQL as SQL_OF_CORE

QUERIES = {}
SQL = {}
#: The roles of a chain a calls b calls c.
_ROLES = ("processing", "data_access", "processing")


def q(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def ne(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return model.nodes(s, d), model.edges(s, d)


# Nodes and changes.
q("nodes_of_files", f"WITH {N} SELECT * FROM N WHERE namespace = '{NS}' AND file_path IS NOT NULL", lambda s, d: graph.nodes_of_files(model.nodes(s, d), NS))


def node_lookup(s: SparkSession, d: str) -> DataFrame:
    """The class of the smallest id."""
    n = model.nodes(s, d)
    first = n.where("label = 'Class'").agg(F.min("id")).scalar()
    return graph.get_node(n, first, "Class")


q("node_lookup", f"WITH {N} SELECT * FROM N WHERE id = (SELECT min(id) FROM N WHERE label = 'Class') AND label = 'Class' LIMIT 1", node_lookup)
_gone = lambda s, d: table(s, d, "deleted_node").select(norm_id("node_id").alias("id"), "name")
q("created_nodes", f"WITH {N}, W AS (SELECT lower(trim(node_id, {_B})) AS id, name, count(*) OVER (PARTITION BY lower(trim(node_id, {_B}))) AS k FROM deleted_node) SELECT W.id, W.name, k = 1 AND W.id NOT IN (SELECT id FROM N) AS created FROM W", lambda s, d: graph.create_nodes(model.nodes(s, d), _gone(s, d)))
_DROP = "R AS (SELECT id FROM N WHERE label IN ('Method', 'Symbol'){0})"
for _detach in (True, False):
    q(f"delete_nodes{'_detached' if _detach else ''}", f"WITH {N}, {E}, {_DROP.format('' if _detach else ' AND id NOT IN (SELECT src FROM E UNION SELECT dst FROM E)')} SELECT label, count(*) AS nodes, (SELECT count(*) FROM E WHERE src NOT IN (FROM R) AND dst NOT IN (FROM R)) AS edges_left FROM N WHERE id NOT IN (FROM R) GROUP BY 1",
      lambda s, d, x=_detach: (lambda ne_: (lambda got: got[0].groupBy("label").agg(F.count("*").alias("nodes")).withColumn("edges_left", got[1].agg(F.count("*")).scalar()))(graph.delete_nodes(*ne_, ne_[0].where("label in ('Method', 'Symbol')"), x)))(ne(s, d)))

# Calls and imports.
q("calls_in_file", f"""WITH {U}, T AS (SELECT namespace, file_path, name, arg_max(id, (line_start, id)) AS dst FROM U WHERE type IN {CODE} GROUP BY ALL), C AS (SELECT id AS src, namespace, file_path, unnest(calls) AS call FROM U WHERE type IN {CODE})
  SELECT DISTINCT C.src, T.dst, 1 AS call_count FROM C JOIN T ON T.namespace = C.namespace AND T.file_path = C.file_path AND T.name = C.call""", lambda s, d: graph.resolve_calls_in_file(model.units(s, d)))
_RESOLVED = f"""C AS (SELECT DISTINCT id AS src, namespace, call FROM (SELECT id, namespace, unnest(calls) AS call FROM U WHERE type IN {CODE}) WHERE call IS NOT NULL),
 T AS (SELECT namespace, name, min(id) AS dst FROM U WHERE type IN {CODE} GROUP BY ALL),
 D AS (SELECT C.src, C.namespace, coalesce(a.dst, b.dst) AS dst FROM C LEFT JOIN T a ON a.namespace = C.namespace AND a.name = C.call LEFT JOIN T b ON b.namespace = C.namespace AND b.name = split_part(C.call, '.', 2)
   AND len(string_split(C.call, '.')) = 2 AND split_part(C.call, '.', 1) IN ('s', 'ctx', 'w', 'r', 'logger', 'client'))"""
q("call_rebuild_counts", f"""WITH {U}, {E}, {_RESOLVED}, O AS (SELECT src, dst FROM E WHERE type = 'CALLS') SELECT D.namespace, count(*) AS calls, count(*) FILTER (D.dst IS NOT NULL AND O.src IS NOT NULL) AS existing,
  count(*) FILTER (D.dst IS NOT NULL AND O.src IS NULL) AS created, count(*) FILTER (D.dst IS NULL) AS not_found, round(count(D.dst) / count(*), 4) AS rate FROM D LEFT JOIN O ON O.src = D.src AND O.dst = D.dst GROUP BY 1""", lambda s, d: graph.rebuild_counts(model.units(s, d), model.edges(s, d)))
q("completeness_by_language", f"""WITH {U}, {E} SELECT split_part(namespace, ':', 2) AS service, language, count(*) AS functions, count(*) FILTER (len(calls) > 0) AS listing_calls, count(c.src) AS with_calls
  FROM U LEFT JOIN (SELECT DISTINCT src FROM E WHERE type = 'CALLS') c ON c.src = U.id WHERE type IN {CODE} GROUP BY ALL""", lambda s, d: graph.completeness_by_language(model.units(s, d), model.edges(s, d)))
q("expected_call_gaps", f"""WITH {U}, {E}, M AS (SELECT DISTINCT id, namespace, unnest(regexp_extract_all(code, '\\b\\w\\.(\\w+)\\(', 1)) AS call FROM U WHERE type IN {CODE})
  SELECT id, call FROM M WHERE NOT EXISTS (SELECT 1 FROM E JOIN U t ON t.id = E.dst WHERE E.type = 'CALLS' AND E.src = M.id AND t.name = M.call AND t.namespace = M.namespace)""", lambda s, d: graph.expected_call_gaps(model.units(s, d), model.edges(s, d)))
_role = lambda c: _case(detect.ROLE_WORDS, c, "'processing'")
q("role_matrix", G + f"SELECT {_role('src_name')} AS from_role, {_role('dst_name')} AS to_role, count(*) AS calls FROM X WHERE type = 'CALLS' GROUP BY ALL", lambda s, d: graph.role_matrix(*ne(s, d), detect.role))
q("role_chain", G + f""", L AS (SELECT id, {_role('name')} AS role FROM N) SELECT b.id AS mid, count(*) AS chains FROM E x JOIN L a ON a.id = x.src AND a.role = '{_ROLES[0]}' JOIN L b ON b.id = x.dst AND b.role = '{_ROLES[1]}'
  JOIN E y ON y.src = b.id AND y.type = 'CALLS' JOIN L c ON c.id = y.dst AND c.role = '{_ROLES[2]}' WHERE x.type = 'CALLS' GROUP BY 1""", lambda s, d: graph.role_chain(*ne(s, d), detect.role, _ROLES))
q("cross_namespace_edges", G + "SELECT type, src_namespace AS from_ns, dst_namespace AS to_ns, count(*) AS edges FROM X WHERE src_namespace <> dst_namespace GROUP BY ALL", lambda s, d: graph.cross_namespace_edges(*ne(s, d)))


def entry_targets(s: SparkSession, d: str) -> DataFrame:
    """From the functions of a name to library symbols."""
    n, e = ne(s, d)
    return graph.entry_to_target(n, e, _starts(n), n.where("label = 'Symbol'").select("id"), 3, 5)


q("entry_targets", GR + f""", {_ST}, T AS (SELECT start, E.dst AS node, 1 AS depth, start || '/' || E.dst AS path, a.name || ' -> ' || b.name AS names, [E.src || E.dst] AS trail FROM ST JOIN E ON E.src = ST.start AND E.type = 'CALLS' JOIN N a ON a.id = E.src JOIN N b ON b.id = E.dst
  UNION ALL SELECT T.start, E.dst, T.depth + 1, T.path || '/' || E.dst, T.names || ' -> ' || b.name, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.node AND E.type = 'CALLS' JOIN N b ON b.id = E.dst WHERE T.depth < 3 AND NOT list_contains(T.trail, E.src || E.dst)),
  R AS (SELECT T.*, row_number() OVER (PARTITION BY start ORDER BY depth, path) AS place FROM T JOIN N ON N.id = T.node WHERE N.label = 'Symbol') SELECT start, node AS target, depth, place, names FROM R WHERE place <= 5""", entry_targets)
# Retrieval and context.
q("retrieve_classes", GR + f""", HIT AS (SELECT id, name FROM N WHERE namespace = '{NS}' AND label = 'Class'), T AS (SELECT src AS class_id, dst AS ancestor_id, [src || dst] AS trail FROM E WHERE type = 'INHERITS_FROM'
  UNION ALL SELECT T.class_id, E.dst, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.ancestor_id AND E.type = 'INHERITS_FROM' WHERE NOT list_contains(T.trail, E.src || E.dst))
  SELECT HIT.id, HIT.name, (SELECT array_to_string(list_sort(list(DISTINCT ancestor_id)), ',') FROM T WHERE T.class_id = HIT.id) AS ancestors FROM HIT""", lambda s, d: (lambda n, e: retrieve.class_with_ancestors(n, e, n.where((F.col("namespace") == NS) & (F.col("label") == "Class")).select("id")))(*ne(s, d)))
_PAR = "SELECT src_id AS id, src_name AS name, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS others, count(DISTINCT dst_id) AS n, 0 AS part FROM X WHERE type = 'PARALLEL_WITH' GROUP BY ALL ORDER BY id LIMIT 10"


def parallel_hits(s: SparkSession, d: str) -> DataFrame:
    """The first steps with what they can run with."""
    return retrieve.retrieve("parallel_steps", *ne(s, d), lambda: None, NS, None, 10)["graph"]


q("retrieve_parallel", G + _PAR, parallel_hits)
q("retrieve_flows_all", G + "SELECT id, name, namespace FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY id) AS r FROM N WHERE label = 'ExecutionFlow') WHERE r <= 10", lambda s, d: retrieve.flows_by_namespace(model.nodes(s, d), 10))
_HITS = f"H AS (SELECT id, round(complexity / 10.0, 6) AS score FROM N WHERE label IN {CODE} AND complexity IS NOT NULL AND namespace = '{NS}' ORDER BY complexity DESC, id LIMIT 20)"
_EXPANDED = "Y AS (SELECT src_id AS id, 'callee' AS relation, dst_id AS other_id, dst_name AS other FROM X WHERE type = 'CALLS' AND src IN (SELECT id FROM H) UNION ALL SELECT dst_id, 'parent', src_id, src_name FROM X WHERE type = 'CONTAINS' AND src_label = 'Class' AND dst IN (SELECT id FROM H))"


def _hits(n: DataFrame) -> DataFrame:
    """Hits of a code search, here the most complex functions of a namespace."""
    return n.where(F.col("label").isin(*graph.CODE) & F.col("complexity").isNotNull() & (F.col("namespace") == NS)).orderBy(F.desc("complexity"), "id").limit(20).select("id", F.round(F.col("complexity") / 10.0, 6).alias("score"))


q("hits_expanded", G + f", {_HITS}, {_EXPANDED} SELECT * FROM Y", lambda s, d: (lambda n, e: retrieve.expand_hits(n, e, _hits(n)))(*ne(s, d)))


def three_legs(s: SparkSession, d: str) -> DataFrame:
    """The nearest documents, code hits, and what these lead to."""
    n, e = ne(s, d)
    v = table(s, d, "embeddings")
    query = list(v.where("vec_id = 0").select("embedding").first()[0])
    docs = vector.search(v.join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), query, 3).select(F.col("vec_id").alias("id"), "score")
    return retrieve.three_legs(docs, _hits(n), n, e)


q("retrieve_three_legs", G + f""", {_HITS}, {_EXPANDED}, V AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, vec_id LIMIT 3)
  SELECT 'documents' AS leg, CAST(vec_id AS VARCHAR) AS id, score, NULL AS relation, NULL AS other FROM V UNION ALL SELECT 'code', id, score, NULL, NULL FROM H UNION ALL SELECT 'graph', Y.id, H.score, relation, other FROM Y JOIN H ON H.id = Y.id""", three_legs)
q("context_vector_items", "WITH C AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS place, lower(trim(source_type)) AS kind FROM context_item) SELECT query_id, item_id, place, kind FROM C WHERE kind IN ('code', 'document')", lambda s, d: context.vector_items(table(s, d, "context_item")).select("query_id", "item_id", "place", "kind"))
q("cited_units", f"WITH {U} SELECT id, '[' || row_number() OVER (ORDER BY id) || '] ' || file_path || coalesce(':' || line_start, '') AS citation FROM (SELECT * FROM U WHERE namespace = '{NS}' AND type = 'Class' ORDER BY id LIMIT 50)", lambda s, d: retrieve.cited(model.units(s, d).where((F.col("namespace") == NS) & (F.col("type") == "Class")).orderBy("id").limit(50)))
q("graph_parallel_item", G + f", P AS ({_PAR}) SELECT '# Parallel Execution Opportunities' || chr(10) || chr(10) || string_agg('**' || name || '**' || chr(10) || '  - Can run in parallel with: ' || replace(others, ',', ', ') || chr(10), chr(10) ORDER BY id) AS content, 0.9 AS relevance_score, '[G1] Parallel Step Analysis' AS citation FROM P HAVING count(*) > 0", lambda s, d: context.format_parallel(parallel_hits(s, d)))
q("graph_dependency_item", G + ", P AS (SELECT src_name AS name, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS deps FROM X WHERE type = 'DEPENDS_ON' GROUP BY 1 ORDER BY 1 LIMIT 25) SELECT '# Dependency Analysis' || chr(10) || chr(10) || string_agg('**' || name || '**' || chr(10) || '  Depends on:' || chr(10) || '  - ' || replace(deps, ',', chr(10) || '  - ') || chr(10), chr(10) ORDER BY name) AS content, 0.85 AS relevance_score, '[G1] Dependency Graph' AS citation FROM P HAVING count(*) > 0", lambda s, d: context.format_dependencies(retrieve.dependencies(*ne(s, d), 25)))


def chain_item(s: SparkSession, d: str) -> DataFrame:
    """The first chains as one item."""
    return context.format_chains(_first_chains(s, d))


def _first_chains(s: SparkSession, d: str) -> DataFrame:
    n, e = ne(s, d)
    t = graph.entry_to_target(n, e, _starts(n), n.select("id"), 2, 3).orderBy("start", "place").limit(20)
    return t.withColumn("place", F.row_number().over(retrieve.in_order("start", "place")))


q("graph_chain_item", GR + f""", {_ST}, T AS (SELECT start, start || '/' || E.dst AS path, 1 AS depth, E.dst AS node, a.name || ' -> ' || b.name AS names, [E.src || E.dst] AS trail FROM ST JOIN E ON E.src = ST.start AND E.type = 'CALLS' JOIN N a ON a.id = E.src JOIN N b ON b.id = E.dst
  UNION ALL SELECT T.start, T.path || '/' || E.dst, T.depth + 1, E.dst, T.names || ' -> ' || b.name, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.node AND E.type = 'CALLS' JOIN N b ON b.id = E.dst WHERE T.depth < 2 AND NOT list_contains(T.trail, E.src || E.dst)),
  R AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, path) AS place FROM T), K AS (SELECT *, row_number() OVER (ORDER BY start, place) AS k FROM R WHERE place <= 3 ORDER BY start, place LIMIT 20)
  SELECT '# Call Chain Analysis' || chr(10) || chr(10) || string_agg('**Chain ' || k || ':**' || chr(10) || '  ' || names || chr(10), chr(10) ORDER BY k) AS content, 0.9 AS relevance_score, '[G1] Call Chain' AS citation FROM K HAVING count(*) > 0""", chain_item)
q("graph_flow_items", G + "SELECT '# Execution Flow' || chr(10) || chr(10) || '**Description:** ' || name || chr(10) AS content, 0.8 AS relevance_score, '[G' || row_number() OVER (ORDER BY id) || '] Execution Flow' AS citation FROM (SELECT * FROM N WHERE label = 'ExecutionFlow' ORDER BY id LIMIT 10)", lambda s, d: context.format_each(model.nodes(s, d).where("label = 'ExecutionFlow'").orderBy("id").limit(10), "find_flow", context.format_flow(), "id"))

# The graph's own flows.
_GS = f"""{N}, {E}, NO AS (SELECT lower(trim(id, {_B})) AS id, max(step_number) AS step FROM graph_node WHERE label = 'Step' AND step_number IS NOT NULL GROUP BY 1),
  INS AS (SELECT src AS flow_id, dst AS id FROM E WHERE type = 'CONTAINS' UNION SELECT dst, src FROM E WHERE type IN ('PART_OF', 'BELONGS_TO')),
  OFS AS (SELECT DISTINCT INS.flow_id, INS.id, NO.step FROM INS JOIN NO ON NO.id = INS.id WHERE flow_id IN (SELECT id FROM N WHERE label = 'ExecutionFlow')),
  DEP AS (SELECT DISTINCT a.flow_id, a.step, b.step AS other FROM OFS a JOIN E ON E.type = 'DEPENDS_ON' AND E.src = a.id JOIN OFS b ON b.flow_id = a.flow_id AND b.id = E.dst),
  ST0 AS (SELECT DISTINCT flow_id, step FROM OFS)"""
q("graph_flow_steps", f"WITH {_GS} SELECT s.flow_id, s.step, coalesce((SELECT array_to_string(list_sort(list(DISTINCT other)), ',') FROM DEP WHERE DEP.flow_id = s.flow_id AND DEP.step = s.step), '') AS deps FROM ST0 s", lambda s, d: model.graph_steps(s, d)[0].select("flow_id", "step", F.array_join("depends_on", ",").alias("deps")))
q("graph_flow_times", f"""WITH RECURSIVE {_GS}, Q AS (SELECT flow_id, step, 1 AS len FROM ST0 UNION SELECT DEP.flow_id, DEP.step, Q.len + 1 FROM Q JOIN DEP ON DEP.flow_id = Q.flow_id AND DEP.other = Q.step WHERE Q.len < 200)
  SELECT t.flow_id, count(*) AS total_steps, CASE WHEN max(m.len) < 200 THEN CAST(max(m.len) AS DOUBLE) END AS critical_time FROM ST0 t JOIN (SELECT flow_id, max(len) AS len FROM Q GROUP BY 1) m ON m.flow_id = t.flow_id GROUP BY 1""", lambda s, d: flow.analyze(*model.graph_steps(s, d))[0].select("flow_id", "total_steps", "critical_time"))
q("graph_flow_analysis", None, lambda s, d: flow.analyze(*model.graph_steps(s, d))[0])
q("graph_flow_critical_steps", None, lambda s, d: flow.analyze(*model.graph_steps(s, d))[1])

# Texts.
q("subsections", """WITH T AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS p FROM documents WHERE text IS NOT NULL), R AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS section_no, unnest(p) AS part FROM T),
  B AS (SELECT doc_id, section_no, trim(CASE WHEN section_no = 0 THEN part ELSE substring(part, instr(part, chr(10)) + 1) END, E' \\t\\r\\n\\f\\x0b') AS body FROM R WHERE section_no = 0 OR contains(part, chr(10))),
  P AS (SELECT doc_id, section_no, length(body) > 3000 AS big, CASE WHEN length(body) > 3000 THEN string_split(body, chr(10) || '### ') ELSE [body] END AS p FROM B), Z AS (SELECT doc_id, section_no, big, generate_subscripts(p, 1) - 1 AS part_no, unnest(p) AS x FROM P)
  SELECT doc_id, section_no, part_no, CASE WHEN big AND part_no > 0 THEN trim(split_part(x, chr(10), 1), E' \\t\\r\\n\\f\\x0b') WHEN big THEN 'main' END AS part, md5(trim(CASE WHEN big AND part_no > 0 THEN CASE WHEN contains(x, chr(10)) THEN substring(x, instr(x, chr(10)) + 1) ELSE '' END ELSE x END, E' \\t\\r\\n\\f\\x0b')) AS body_md5 FROM Z""",
  lambda s, d: text.subsections(text.sections(table(s, d, "documents").where("text is not null"), "doc_id", "text")).select("doc_id", "section_no", "part_no", "part", F.md5("body").alias("body_md5")))
q("hash_embedding_totals", f"""WITH {U}, H AS (SELECT id, sha256(concat_ws(chr(10), nullif(signature, ''), nullif(docstring, ''), nullif(substring(code, 1, 500), ''))) AS h FROM U)
  SELECT id, round(12 * list_sum([CAST('0x' || substring(h, CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0 * 2 - 1 for i in range(32)]), 4) AS total, 384 AS dims FROM H""", lambda s, d: model.units(s, d).select("id", vector.hash_embedding(vector.unit_text()).alias("e")).select("id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("e").alias("dims")))

# SQL of queries that stand in other modules.
_UNIT_TEXT = "concat_ws(chr(10), nullif(signature, ''), nullif(docstring, ''), nullif(substring(code, 1, 500), ''))"
_BYTES = "[CAST('0x' || substring(h, CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0 * 2 - 1 for i in range(32)]"
SQL["hash_embeddings"] = f"WITH {U}, H AS (SELECT id, sha256({_UNIT_TEXT}) AS h FROM U) SELECT id, round(12 * list_sum({_BYTES}), 6) AS total, 384 AS dims FROM H"
SQL["formatted_code"] = f"""WITH {U} SELECT id, md5(concat_ws(chr(10), '# ' || upper(type) || ': ' || name, 'Location: ' || file_path || ':' || line_start, CASE WHEN length(signature) > 0 THEN '```' || chr(10) || signature || chr(10) || '```' END,
  CASE WHEN length(docstring) > 0 THEN '**Documentation:**' || chr(10) || docstring END, CASE WHEN length(code) > 0 THEN '**Implementation:**' || chr(10) || '```' || chr(10) || code || chr(10) || '```' END,
  CASE WHEN len(calls) > 0 THEN '**Calls:** ' || array_to_string(calls, ', ') END, CASE WHEN len(imports) > 0 THEN '**Imports:** ' || array_to_string(imports, ', ') END)) AS content_md5 FROM U"""
SQL["http_endpoints"] = """WITH F AS (SELECT file_id, lower(regexp_extract(file_path, '([.][^./]+)$', 1)) AS x, code FROM source_file), P AS (
  SELECT file_id, unnest(regexp_extract_all(code, 'r\\.Methods\\("([A-Z]+)"\\)\\.Path\\("(/[^"]+)"\\)\\.Handler', 1)) AS m, unnest(regexp_extract_all(code, 'r\\.Methods\\("([A-Z]+)"\\)\\.Path\\("(/[^"]+)"\\)\\.Handler', 2)) AS path FROM F WHERE x = '.go'
  UNION ALL SELECT file_id, unnest(regexp_extract_all(code, '(?i)(?:app|router)\\.(get|post|put|delete|patch)\\([''"]([^''"]+)[''"]', 1)), unnest(regexp_extract_all(code, '(?i)(?:app|router)\\.(get|post|put|delete|patch)\\([''"]([^''"]+)[''"]', 2)) FROM F WHERE x IN ('.js', '.jsx')
  UNION ALL SELECT file_id, unnest(regexp_extract_all(code, '@(Get|Post|Put|Delete)Mapping\\([''"]([^''"]+)[''"]', 1)), unnest(regexp_extract_all(code, '@(Get|Post|Put|Delete)Mapping\\([''"]([^''"]+)[''"]', 2)) FROM F WHERE x = '.java')
  SELECT file_id, upper(m) AS method, path FROM P"""
_WALK = "UNION SELECT R.start, H.b, R.depth + 1, R.path || '/' || H.b FROM R JOIN H ON H.a = R.node WHERE R.depth < 4"
SQL["shortest_paths"] = GR + f""", O AS (SELECT DISTINCT src AS a, dst AS b FROM E WHERE type = 'NEXT_STEP'), H AS (SELECT a, b FROM O UNION SELECT b, a FROM O),
  D AS (SELECT a AS start, a AS node, 0 AS depth FROM O UNION SELECT D.start, O.b, D.depth + 1 FROM D JOIN O ON O.a = D.node WHERE D.depth < 4), W AS (SELECT start, node AS target FROM D GROUP BY ALL HAVING min(depth) >= 2),
  R AS (SELECT DISTINCT start, start AS node, 0 AS depth, start AS path FROM W {_WALK}), M AS (SELECT start, node, min(depth) AS depth FROM R GROUP BY ALL)
  SELECT W.start, W.target, M.depth, min(R.path) AS path FROM W JOIN M ON M.start = W.start AND M.node = W.target JOIN R ON R.start = M.start AND R.node = M.node AND R.depth = M.depth GROUP BY ALL"""
SQL["root_leaf_paths"] = GR + """, O AS (SELECT src, dst FROM E WHERE type = 'NEXT_STEP'), T AS (SELECT src AS start, dst AS node, 1 AS depth, src || '/' || dst AS path, [src || dst] AS trail FROM O WHERE src NOT IN (SELECT dst FROM O)
  UNION ALL SELECT T.start, O.dst, T.depth + 1, T.path || '/' || O.dst, list_append(T.trail, O.src || O.dst) FROM T JOIN O ON O.src = T.node WHERE NOT list_contains(T.trail, O.src || O.dst)) SELECT start, node, depth, path FROM T WHERE node NOT IN (SELECT src FROM O)"""
_CHUNKED = SQL_OF_CORE["greedy_chunks"].replace("> 600", "> 1500")
SQL["formatted_documents"] = _CHUNKED[: _CHUNKED.rindex("SELECT doc_id, chunk_index")] + "SELECT C.doc_id, chunk_index, md5('# ' || coalesce(nullif(d.title, ''), 'Document Chunk ' || (chunk_index + 1)) || chr(10) || 'Source: ' || d.source || chr(10) || chr(10) || content) AS content_md5 FROM C JOIN documents d ON d.doc_id = C.doc_id"
_NEAR = f"""V AS (SELECT id, {_BYTES} AS v FROM (SELECT id, sha256({_UNIT_TEXT}) AS h FROM U WHERE type IN {CODE})), UH AS (SELECT id, round(list_cosine_similarity(v, (SELECT v FROM V ORDER BY id LIMIT 1)), 6) AS score FROM V ORDER BY score DESC, id LIMIT 10)"""
SQL["retrieve_unit_hits"] = f"WITH {U}, {_NEAR} SELECT * FROM UH"
SQL["retrieve_functions"] = G + f", {U}, {_NEAR}, {LISTS} SELECT FC.* FROM FC WHERE id IN (SELECT id FROM UH)"


def _choice(k: int) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(lower(text), '" + "|".join(f"(?:{p})" for p in r[4]) + f"') THEN {str(r[k]).lower()}" for r in intent.INTENTS) + f" ELSE {str(intent.DEFAULT[k]).lower()} END"


q("intent_flags", f"SELECT doc_id, {_choice(1)} AS confidence, {_choice(2)} AS requires_graph, {_choice(3)} AS requires_vector FROM documents WHERE text IS NOT NULL", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in intent.classify(F.col("text")).items() if k != "intent"]))
_POINTS = _CHUNKED.replace("> 1500", "> 1000")
q("chunk_points", _POINTS[: _POINTS.rindex("SELECT doc_id, chunk_index")] + """, PT AS (SELECT C.doc_id, chunk_index, content, d.source, d.title, md5(C.doc_id || '_' || chunk_index) AS h FROM C JOIN documents d ON d.doc_id = C.doc_id)
  SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS point_id, doc_id, chunk_index, title, source, md5(content) AS content_md5, 384 AS dims FROM PT""",
  lambda s, d: vector.chunk_points(text.chunk_rows(table(s, d, "documents"), "doc_id", "text", 1000), table(s, d, "documents")).select("point_id", "payload.doc_id", "payload.chunk_index", "payload.title", "payload.source", F.md5("payload.content").alias("content_md5"), F.size("embedding").alias("dims")))
