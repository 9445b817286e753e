"""Context assembly: first of equals, rank, filter, budget, summary and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score to be exceeded; characters per token; characters that make two contents equal.
LEAST_SCORE, CHARS_PER_TOKEN, SAME_CHARS = 0.3, 4, 200


def dedupe(items: DataFrame) -> DataFrame:
    """Per query the first of the items whose contents agree in the first 200 characters, by id. Null contents are
    left out. The first is a minimum, taken with partial aggregation, so much repeated contents are no hot group."""
    cols = [c for c in items.columns if c not in ("query_id", "item_id")]
    first = items.where("content is not null").groupBy("query_id", F.substring("content", 1, SAME_CHARS).alias("_same")).agg(F.min_by(F.struct("item_id", *cols), "item_id").alias("_i"))
    return first.select("query_id", "_i.item_id", *[f"_i.{c}" for c in cols])


def ranked(items: DataFrame) -> DataFrame:
    """Items above the least score; scores are clamped to 0..1, null scores are 0."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("relevance_score", F.lit(0.0))))
    return items.withColumn("score", s).where(F.col("score") > LEAST_SCORE)


def within_budget(items: DataFrame, max_tokens: int) -> DataFrame:
    """Per query the prefix by score whose tokens fit; the first that doesn't fit ends it.

    Token counts aren't negative, so the prefix is a filter on the running sum. A query with very many items is first cut
    per salt: an item before which its own salt already exceeds the budget can't be in the whole prefix, and the item that
    exceeds it stays, so that it still ends the whole.
    """
    tokens = F.floor(F.char_length("content") / CHARS_PER_TOKEN)
    x = items.withColumn("tokens", tokens).withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.lit(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    order = [F.desc("score"), "item_id"]
    cum = lambda *by: F.sum("tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_c", cum("query_id", "_salt")).where(F.col("_c") - F.col("tokens") <= max_tokens)
    return x.withColumn("running", cum("query_id")).where(F.col("running") <= max_tokens).drop("_c", "_salt")


def summary(items: DataFrame) -> DataFrame:
    """A line per query with the numbers of items by source."""
    kind = F.lower(F.trim("source_type"))
    c = items.groupBy("query_id").agg(*[F.count_if(kind == k).alias(k) for k in ("code", "document", "graph")])
    part = lambda k, text: F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(text)))
    return c.select("query_id", F.concat(F.lit("Retrieved "), F.concat_ws(", ", part("code", " code units"), part("document", " document chunks"), part("graph", " graph analyses"))).alias("summary"))


def format_code() -> Column:
    """A code hit with header, place, signature, documentation, code, calls and imports; absent parts are left out."""
    fence = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))
    has = lambda c, x: F.when(F.length(F.col(c)) > 0, x)
    listed = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.upper("type"), F.lit(": "), F.col("name")),
        F.concat(F.lit("Location: "), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string")),
        has("signature", fence(F.col("signature"))),
        has("docstring", F.concat(F.lit("**Documentation:**\n"), F.col("docstring"))),
        has("code", F.concat(F.lit("**Implementation:**\n"), fence(F.col("code")))),
        listed("calls", "**Calls:** "),
        listed("imports", "**Imports:** "),
    )


def format_document() -> Column:
    """A document hit under its title or its number."""
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Document Chunk "), (F.col("chunk_index") + 1).cast("string")))), F.concat(F.lit("Source: "), F.col("source")), F.lit(""), F.col("content"))


#: Scores of graph items by intent, and their citations.
GRAPH_SCORES = {"find_flow": 0.8, "parallel_steps": 0.9, "trace_calls": 0.9, "find_dependencies": 0.85, "generic": 0.7}
GRAPH_CITATIONS = {"find_flow": "Execution Flow", "parallel_steps": "[G1] Parallel Step Analysis", "trace_calls": "[G1] Call Chain", "find_dependencies": "[G1] Dependency Graph", "generic": "Graph Result"}


def citation(place: Column, path: Column, line: Column) -> Column:
    """[place] and where the hit lies; a place is kept from before hits of other kinds are left out."""
    return F.concat(F.lit("["), place.cast("string"), F.lit("] "), path, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")))


def vector_items(items: DataFrame) -> DataFrame:
    """Per query the items of code and of documents, numbered before the others are left out."""
    w = Window.partitionBy("query_id").orderBy("item_id")
    x = items.withColumn("place", F.row_number().over(w)).withColumn("kind", F.lower(F.trim("source_type")))
    return x.where(F.col("kind").isin("code", "document"))


def one_item(rows: DataFrame, intent: str, title: str, block: Column, order: list[str]) -> DataFrame:
    """All rows as one item under a title: (content, relevance_score, citation); of no rows none. The rows are a bounded
    result list (the first k of a look-up)."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*order, block.alias("_b")))).alias("_l")).where(F.size("_l") > 0)
    content = F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), F.array_join(F.transform("_l", lambda x: F.concat(x["_b"], F.lit("\n"))), "\n"))
    return listed.select(content.alias("content"), F.lit(GRAPH_SCORES[intent]).alias("relevance_score"), F.lit(GRAPH_CITATIONS[intent]).alias("citation"))


def format_parallel(rows: DataFrame) -> DataFrame:
    """Steps (id, name, others) with what they can run with."""
    block = F.concat_ws("\n", F.concat(F.lit("**"), F.col("name"), F.lit("**")), F.concat(F.lit("  - Can run in parallel with: "), F.replace("others", F.lit(","), F.lit(", "))))
    return one_item(rows, "parallel_steps", "Parallel Execution Opportunities", block, ["id"])


def format_chains(rows: DataFrame) -> DataFrame:
    """Call chains (place, names)."""
    block = F.concat(F.lit("**Chain "), F.col("place").cast("string"), F.lit(":**\n  "), F.col("names"))
    return one_item(rows, "trace_calls", "Call Chain Analysis", block, ["place"])


def format_dependencies(rows: DataFrame) -> DataFrame:
    """Names with what they depend on (comma list)."""
    block = F.concat(F.lit("**"), F.col("name"), F.lit("**\n"), F.when(F.length("dependencies") > 0, F.concat(F.lit("  Depends on:\n  - "), F.replace("dependencies", F.lit(","), F.lit("\n  - ")))).otherwise("  No dependencies"))
    return one_item(rows, "find_dependencies", "Dependency Analysis", block, ["name"])


def format_each(rows: DataFrame, intent: str, content: Column, order: str) -> DataFrame:
    """An item per row (flows, generic results), cited by its number."""
    n = F.row_number().over(Window.orderBy(order)).cast("string")
    return rows.select(content.alias("content"), F.lit(GRAPH_SCORES[intent]).alias("relevance_score"), F.concat(F.lit("[G"), n, F.lit(f"] {GRAPH_CITATIONS[intent]}")).alias("citation"))


def format_flow() -> Column:
    """An execution flow by its name."""
    return F.concat(F.lit("# Execution Flow\n\n**Description:** "), F.col("name"), F.lit("\n"))
