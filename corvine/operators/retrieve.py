"""Retrieval plans per intent: vector hits, graph look-ups, or both, as one lazy plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.operators import context, graph, vector


def by_vector(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The nearest k."""
    return vector.search(vectors, query, k)


def function_with_context(n: DataFrame, e: DataFrame, hits: DataFrame) -> DataFrame:
    """R2: hits that are functions, with callees, callers and parents; kinds are compared in any case."""
    return hits.join(graph.function_lists(n, e), "id")


def class_with_ancestors(n: DataFrame, e: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that are classes, each with the number and list of its ancestors."""
    up = graph.class_hierarchy(n, e).groupBy(F.col("class_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("ancestor_id")), ",").alias("ancestors"))
    return hits.join(n.where(F.lower("label") == "class").select("id", "name"), "id").join(up, "id", "left")


def usage(n: DataFrame, e: DataFrame, namespace: str, term: str, context: Callable[[DataFrame, DataFrame], DataFrame] = graph.function_lists) -> DataFrame:
    """Functions whose name holds the term, with who calls them and their context; graph only."""
    found = graph.search_by_name(n, namespace, term, 5).select("id")
    return found.join(context(n, e), "id")


def trace(n: DataFrame, e: DataFrame, namespace: str, term: str, depth: int, k: int) -> DataFrame:
    """Call chains from the first function whose name holds the term, the shortest k."""
    start = graph.search_by_name(n.where(F.col("label").isin(*graph.CODE)), namespace, term, 1).select(F.col("id").alias("start"))
    return graph.call_chains(n, e, start, depth).orderBy("depth", "path").limit(k)


def flows(n: DataFrame, namespace: str, k: int) -> DataFrame:
    """Execution flows of a namespace."""
    return n.where((F.col("label") == "ExecutionFlow") & (F.col("namespace") == namespace)).select("id", "name").orderBy("id").limit(k)


def flows_by_namespace(n: DataFrame, k: int) -> DataFrame:
    """R6 for all namespaces at once: the first k execution flows of each."""
    w = Window.partitionBy("namespace").orderBy("id")
    return n.where("label = 'ExecutionFlow'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("id", "name", "namespace")


def in_order(*columns: str):
    """The window over the rows of a bounded result list in an order, to number them."""
    return Window.orderBy(*columns)


def cited(hits: DataFrame) -> DataFrame:
    """(id, citation) of a bounded list of code hits, numbered by id."""
    return hits.select("id", context.citation(F.row_number().over(in_order("id")), F.col("file_path"), F.col("line_start")).alias("citation"))


def dependencies(n: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """Names with what they depend on, grouped by name, the first k."""
    x = graph.ends(n, e, "DEPENDS_ON")
    return x.groupBy(F.col("src_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("dst_name")), ",").alias("dependencies")).orderBy("name").limit(k)


#: The plan of each intent; others go to the vectors alone.
PLANS: dict[str, str] = {"find_function": "function", "find_class": "class", "find_usage": "usage", "trace_calls": "trace", "find_flow": "flows", "parallel_steps": "parallel", "find_dependencies": "dependencies"}


def retrieve(intent: str, n: DataFrame, e: DataFrame, hits: Callable[[], DataFrame], namespace: str, name: str | None, k: int = 10) -> dict[str, DataFrame]:
    """The frames of an intent: ``vector`` and/or ``graph``; nothing runs before they are read.

    ``hits`` makes the vector hits with an ``id`` column, and is called only for intents that need them. Without a name,
    intents about a name have no graph part.
    """
    plan = PLANS.get(intent)
    out = {} if plan in ("usage", "trace") else {"vector": hits()}
    if plan == "function":
        out["graph"] = function_with_context(n, e, out["vector"].select("id"))
    elif plan == "class":
        out["graph"] = class_with_ancestors(n, e, out["vector"].select("id"))
    elif plan == "usage" and name:
        out["graph"] = usage(n, e, namespace, name)
    elif plan == "trace" and name:
        out["graph"] = trace(n, e, namespace, name, 5, k)
    elif plan == "flows":
        out["graph"] = flows(n, namespace, k)
    elif plan == "parallel":
        out["graph"] = graph.grouped_neighbours(n, e, "PARALLEL_WITH").orderBy("id").limit(k)
    elif plan == "dependencies":
        out["graph"] = dependencies(n, e, k)
    return out


def expand_hits(n: DataFrame, e: DataFrame, hits: DataFrame) -> DataFrame:
    """V9: (id, relation, other_id, other): the callees and the containing class of each hit."""
    near = hits.select("id")
    out = e.where("type = 'CALLS'").join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.lit("callee").alias("relation"), F.col("dst").alias("other_id"))
    up = e.where("type = 'CONTAINS'").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("parent").alias("relation"), F.col("src").alias("other_id"))
    names = n.select(F.col("id").alias("other_id"), F.col("name").alias("other"), "label")
    return out.unionByName(up).join(names, "other_id").where("relation = 'callee' or label = 'Class'").select("id", "relation", "other_id", "other")


def three_legs(documents: DataFrame, code: DataFrame, n: DataFrame, e: DataFrame) -> DataFrame:
    """(leg, id, score, relation, other): nearest documents and code (id, score), and what the code hits lead to."""
    none = [F.lit(None).cast("string").alias(c) for c in ("relation", "other")]
    docs = documents.select(F.lit("documents").alias("leg"), F.col("id").cast("string").alias("id"), "score", *none)
    hits = code.select(F.lit("code").alias("leg"), "id", "score", *none)
    graph_leg = expand_hits(n, e, code).join(code.select("id", "score"), "id").select(F.lit("graph").alias("leg"), "id", "score", "relation", "other")
    return docs.unionByName(hits).unionByName(graph_leg)


def fan_out(vectors: DataFrame, query: list[float], docs: DataFrame) -> DataFrame:
    """Nearest documents of every source, the best three of each."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(F.col("vec_id").alias("doc_id"), F.round(vector.cosine(F.col("embedding"), q), 6).alias("score")).join(docs.select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 3")
