"""Queries of the retrieval plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine import model
from corvine.common import table
from corvine.operators import graph, retrieve, vector
from corvine.plans.core import CODE, G, GR, LISTS, NS

QUERIES = {}
SQL = {}


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


_ne = lambda s, d: (model.nodes(s, d), model.edges(s, d))
_add("retrieve_usage", lambda s, d: retrieve.usage(*_ne(s, d), NS, "poll", graph.function_context), G + f""", F AS (SELECT id FROM N WHERE namespace = '{NS}' AND contains(lower(name), 'poll') ORDER BY name, id LIMIT 5)
  SELECT N.id, N.name, coalesce(a.c, '') AS callees, coalesce(b.c, 0) AS n_callers, coalesce(p.c, '') AS parents FROM N JOIN F ON F.id = N.id
  LEFT JOIN (SELECT src_id AS id, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS c FROM X WHERE type = 'CALLS' GROUP BY 1) a ON a.id = N.id
  LEFT JOIN (SELECT dst_id AS id, count(DISTINCT src_id) AS c FROM X WHERE type = 'CALLS' GROUP BY 1) b ON b.id = N.id
  LEFT JOIN (SELECT dst_id AS id, array_to_string(list_sort(list(DISTINCT src_name)), ',') AS c FROM X WHERE type = 'CONTAINS' AND src_label = 'Class' GROUP BY 1) p ON p.id = N.id WHERE N.label IN {CODE}""")
_add("retrieve_callers", lambda s, d: retrieve.usage(*_ne(s, d), NS, "poll"), G + f", F AS (SELECT id FROM N WHERE namespace = '{NS}' AND contains(lower(name), 'poll') ORDER BY name, id LIMIT 5), {LISTS} SELECT * FROM FC WHERE id IN (FROM F)")
_add("retrieve_trace", lambda s, d: retrieve.trace(*_ne(s, d), NS, "poll", 3, 20), GR + f""", ST AS (SELECT id AS start FROM N WHERE label IN {CODE} AND namespace = '{NS}' AND contains(lower(name), 'poll') ORDER BY name, id LIMIT 1),
  T AS (SELECT start, E.dst AS node, 1 AS depth, start || '/' || E.dst AS path, [E.src || E.dst] AS trail FROM ST JOIN E ON E.src = ST.start AND E.type = 'CALLS'
  UNION ALL SELECT T.start, E.dst, T.depth + 1, T.path || '/' || E.dst, list_append(T.trail, E.src || E.dst) FROM T JOIN E ON E.src = T.node AND E.type = 'CALLS' WHERE T.depth < 3 AND NOT list_contains(T.trail, E.src || E.dst))
  SELECT T.start, T.node, N.name AS end_name, T.depth, T.path FROM T JOIN N ON N.id = T.node ORDER BY T.depth, T.path LIMIT 20""")
_add("retrieve_flows", lambda s, d: retrieve.flows(model.nodes(s, d), NS, 10), G + f"SELECT id, name FROM N WHERE label = 'ExecutionFlow' AND namespace = '{NS}' ORDER BY id LIMIT 10")
_add("retrieve_dependencies", lambda s, d: retrieve.dependencies(*_ne(s, d), 25), G + "SELECT src_name AS name, array_to_string(list_sort(list(DISTINCT dst_name)), ',') AS dependencies FROM X WHERE type = 'DEPENDS_ON' GROUP BY 1 ORDER BY 1 LIMIT 25")


def _query(s: SparkSession, d: str) -> list[float]:
    return list(table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_add("retrieve_fan_out", lambda s, d: retrieve.fan_out(table(s, d, "embeddings"), _query(s, d), table(s, d, "documents")), """WITH V AS (SELECT vec_id AS doc_id, source, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings JOIN documents ON doc_id = vec_id),
  R AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM V) SELECT doc_id, source, score, place FROM R WHERE place <= 3""")


def _unit_hits(s: SparkSession, d: str) -> DataFrame:
    """Units nearest to one unit's text by the offline embedding."""
    u = model.units(s, d).where(F.col("type").isin(*graph.CODE)).select("id", vector.unit_text().alias("t"))
    e = vector.embed(u, "t")
    q = u.orderBy("id").limit(1).select(vector.hash_embedding(F.col("t")).alias("e")).first()[0]
    qv = F.array(*[F.lit(x) for x in q])
    return e.select("id", F.round(vector.cosine(F.col("embedding"), qv), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def _with_context(s: SparkSession, d: str) -> DataFrame:
    n, e = _ne(s, d)
    got = retrieve.retrieve("find_function", n, e, lambda: _unit_hits(s, d), NS, None)
    return got["graph"]


_add("retrieve_functions", _with_context, None)
_add("retrieve_unit_hits", _unit_hits, None)
