"""Further analytic queries over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine import model
from corvine.common import table
from corvine.operators import context, detect, expand, flow, graph
from corvine.plans.core import CODE, FL, G, N, NS, S, U, _reach_sql, _starts, _trails

QUERIES = {}
SQL = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@q("pattern_file_coverage", f"WITH {U}, F AS (SELECT DISTINCT namespace, file_path FROM U) SELECT namespace, count(*) AS files, count(*) FILTER (contains(lower(file_path), 'route') OR contains(lower(file_path), 'handler')) AS matching, round(count(*) FILTER (contains(lower(file_path), 'route') OR contains(lower(file_path), 'handler')) / count(*), 4) AS ratio FROM F GROUP BY 1")
def pattern_file_coverage(s: SparkSession, d: str) -> DataFrame:
    """Distinct files per namespace and those whose path holds one of the words."""
    hit = F.contains(F.lower("file_path"), F.lit("route")) | F.contains(F.lower("file_path"), F.lit("handler"))
    f = model.units(s, d).select("namespace", "file_path").distinct()
    return f.groupBy("namespace").agg(F.count("*").alias("files"), F.count_if(hit).alias("matching")).withColumn("ratio", F.round(F.col("matching") / F.col("files"), 4))


@q("prefix_methods", G + "SELECT src_id AS class_id, src_name AS class, dst_name AS method, dst_id AS method_id FROM X WHERE type = 'CONTAINS' AND src_label = 'Class' AND dst_label = 'Method' AND starts_with(dst_name, 'merge')")
def prefix_methods(s: SparkSession, d: str) -> DataFrame:
    """Methods of classes whose name begins with a prefix."""
    x = graph.ends(model.nodes(s, d), model.edges(s, d), "CONTAINS")
    return x.where((F.col("src_label") == "Class") & (F.col("dst_label") == "Method") & F.col("dst_name").startswith("merge")).select(F.col("src_id").alias("class_id"), F.col("src_name").alias("class"), F.col("dst_name").alias("method"), F.col("dst_id").alias("method_id"))


@q("code_search", f"WITH {U} SELECT id, name FROM U WHERE type IN {CODE} AND contains(code, 'limit') AND contains(code, 'throw')")
def code_search(s: SparkSession, d: str) -> DataFrame:
    """Functions whose code holds all given texts."""
    u = model.units(s, d)
    return u.where(F.col("type").isin(*graph.CODE) & F.contains("code", F.lit("limit")) & F.contains("code", F.lit("throw"))).select("id", "name")


@q("file_endings", f"WITH {U} SELECT split_part(namespace, ':', 2) AS service, lower(string_split(file_path, '.')[-1]) AS ending, count(DISTINCT file_path) AS files, count(*) FILTER (ends_with(name, 'Service') OR starts_with(lower(name), 'verify')) AS matching FROM U GROUP BY ALL")
def file_endings(s: SparkSession, d: str) -> DataFrame:
    """Files by service and ending, with names that begin or end in a given way."""
    u = model.units(s, d)
    hit = F.col("name").endswith("Service") | F.lower("name").startswith("verify")
    return u.groupBy(model.service().alias("service"), F.lower(F.element_at(F.split("file_path", r"\."), -1)).alias("ending")).agg(F.count_distinct("file_path").alias("files"), F.count_if(hit).alias("matching"))


@q("named_edge_counts", G + "SELECT type, src_name, dst_name, count(*) AS edges FROM X WHERE type IN ('CALLS', 'DEPENDS_ON') GROUP BY ALL HAVING count(*) > 1")
def named_edge_counts(s: SparkSession, d: str) -> DataFrame:
    """Pairs of names that more than one edge of a type joins."""
    n, e = model.nodes(s, d), model.edges(s, d)
    x = graph.ends(n, e, "CALLS").unionByName(graph.ends(n, e, "DEPENDS_ON"))
    return x.groupBy("type", "src_name", "dst_name").agg(F.count("*").alias("edges")).where("edges > 1")


@q("language_pivot", f"WITH {N} SELECT split_part(namespace, ':', 2) AS service, " + ", ".join(f"count(*) FILTER (lower(trim(language)) = '{x}') AS {x}" for x in ("python", "javascript", "typescript", "go", "java")) + f" FROM N WHERE label IN {CODE} GROUP BY 1")
def language_pivot(s: SparkSession, d: str) -> DataFrame:
    """A2: a service's units, a column for each language."""
    n = model.nodes(s, d).where(F.col("label").isin(*graph.CODE))
    return n.groupBy(model.service().alias("service")).agg(*[F.count_if(F.lower(F.trim("language")) == x).alias(x) for x in ("python", "javascript", "typescript", "go", "java")])


@q("chain_texts", _trails(2) + "SELECT T.start, T.path, a.name || ' -> ' || coalesce(m.name || ' -> ', '') || b.name AS chain FROM T JOIN N a ON a.id = T.start JOIN N b ON b.id = T.node LEFT JOIN N m ON T.depth = 2 AND m.id = split_part(T.path, '/', 2)")
def chain_texts(s: SparkSession, d: str) -> DataFrame:
    """Call chains of up to two hops as text."""
    n, e = model.nodes(s, d), model.edges(s, d)
    t = expand.trails(e.where("type = 'CALLS'"), _starts(n), 2)
    names = n.select("id", "name")
    x = t.join(names.select(F.col("id").alias("start"), F.col("name").alias("a")), "start").join(names.select(F.col("id").alias("node"), F.col("name").alias("b")), "node")
    mid = F.when(F.col("depth") == 2, F.col("path")[1])
    x = x.withColumn("_m", mid).join(names.select(F.col("id").alias("_m"), F.col("name").alias("m")), "_m", "left")
    return x.select("start", F.array_join("path", "/").alias("path"), F.concat_ws(" -> ", "a", "m", "b").alias("chain"))


@q("flow_outline", _reach_sql(3, False) + "SELECT M.start, M.node, M.depth, repeat('  ', M.depth) || '- ' || N.name AS line FROM M JOIN N ON N.id = M.node")
def flow_outline(s: SparkSession, d: str) -> DataFrame:
    """What entries reach over calls, indented."""
    n, e = model.nodes(s, d), model.edges(s, d)
    return detect.outline(expand.reach(e.where("type = 'CALLS'"), _starts(n), 3), n)


@q("flow_metrics", f"""WITH RECURSIVE {S}, Q AS (SELECT flow_id, step, minutes AS f1, CAST(0 AS DOUBLE) AS f2, minutes AS best FROM S WHERE step = 1
  UNION ALL SELECT S.flow_id, S.step, S.minutes + CASE S.flag WHEN 'A' THEN Q.f1 WHEN 'R' THEN greatest(Q.f1, Q.f2) ELSE CAST(0 AS DOUBLE) END, Q.f1, greatest(Q.best, S.minutes + CASE S.flag WHEN 'A' THEN Q.f1 WHEN 'R' THEN greatest(Q.f1, Q.f2) ELSE CAST(0 AS DOUBLE) END) FROM Q JOIN S ON S.flow_id = Q.flow_id AND S.step = Q.step + 1),
  B AS (SELECT flow_id, max(best) AS c FROM Q GROUP BY 1), T AS (SELECT flow_id, count(*) AS steps, sum(minutes) AS t FROM S GROUP BY 1)
  SELECT T.flow_id, steps, t AS sequential_time, c AS critical_time, round(CASE WHEN t > 0 THEN 100 * (t - c) / t END, 4) AS optimization_pct FROM T JOIN B ON B.flow_id = T.flow_id""")
def flow_metrics(s: SparkSession, d: str) -> DataFrame:
    """Steps, sequential and critical time of every flow and what running in parallel could save."""
    st = model.steps(s, d)
    t = st.groupBy("flow_id").agg(F.count("*").alias("steps"), F.sum("minutes").alias("sequential_time"))
    pct = F.when(F.col("sequential_time") > 0, 100 * (F.col("sequential_time") - F.col("critical_time")) / F.col("sequential_time"))
    return t.join(flow.critical_paths(st).drop("critical_path"), "flow_id").withColumn("optimization_pct", F.round(pct, 4))


@q("flow_step_counts", FL + "SELECT flow_id, count(*) AS steps, count(*) FILTER (len(depends_on) = 0) AS free_steps, max(minutes) AS longest FROM S GROUP BY 1")
def flow_step_counts(s: SparkSession, d: str) -> DataFrame:
    """steps of each flow, those without dependencies, and the longest."""
    return model.steps(s, d).groupBy("flow_id").agg(F.count("*").alias("steps"), F.count_if(F.size("depends_on") == 0).alias("free_steps"), F.max("minutes").alias("longest"))


@q("context_kinds", "SELECT lower(trim(source_type)) AS kind, count(*) AS items, count(DISTINCT query_id) AS queries, count(*) FILTER (content IS NULL OR content = '') AS empty FROM context_item GROUP BY 1")
def context_kinds(s: SparkSession, d: str) -> DataFrame:
    """Items by source, with those that hold nothing."""
    c = table(s, d, "context_item")
    return c.groupBy(F.lower(F.trim("source_type")).alias("kind")).agg(F.count("*").alias("items"), F.count_distinct("query_id").alias("queries"), F.count_if(F.coalesce(F.length("content"), F.lit(0)) == 0).alias("empty"))


@q("context_fill", "WITH D AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substring(content, 1, 200) ORDER BY item_id) AS r FROM context_item WHERE content IS NOT NULL) WHERE r = 1), L AS (SELECT *, least(1.0, greatest(0.0, coalesce(relevance_score, 0.0))) AS score, CAST(floor(length(content) / 4) AS BIGINT) AS tokens FROM D), W AS (SELECT query_id, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM L WHERE score > 0.3) SELECT query_id, count(*) AS items, max(running) AS tokens FROM W WHERE running <= 2000 GROUP BY 1")
def context_fill(s: SparkSession, d: str) -> DataFrame:
    """What the assembled context of each query holds."""
    kept = context.within_budget(context.ranked(context.dedupe(table(s, d, "context_item"))), 2000)
    return kept.groupBy("query_id").agg(F.count("*").alias("items"), F.max("running").alias("tokens"))


@q("namespace_calls", G + f"SELECT dst_label AS label, count(*) AS calls, count(DISTINCT src_id) AS callers FROM X WHERE type = 'CALLS' AND src_namespace = '{NS}' GROUP BY 1")
def namespace_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls out of a namespace by what they call."""
    x = graph.ends(model.nodes(s, d), model.edges(s, d), "CALLS").where(F.col("src_namespace") == NS)
    return x.groupBy(F.col("dst_label").alias("label")).agg(F.count("*").alias("calls"), F.count_distinct("src_id").alias("callers"))
