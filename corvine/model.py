"""The data model: nodes, edges and flows projected from the tables, and the identity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.common import iso_ts, norm_id, table
from corvine.sources import store


def unit_id(path: Column, line: Column, name: Column) -> Column:
    """First 16 hex digits of the SHA-256 of path:line:name."""
    return F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), name), 256), 1, 16)


def point_id(raw: Column) -> Column:
    """A vector point's id: hex ids are padded to the form of a UUID, other ids become the UUID of their MD5."""
    hexed = F.replace(raw, F.lit("-"), F.lit(""))
    digits = F.when(hexed.rlike("^[0-9a-fA-F]*$"), F.rpad(F.substring(hexed, 1, 32), 32, "0")).otherwise(F.md5(raw))
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


UNIT_COLUMNS = ["name", "type", "file_path", "language", "signature", "docstring", "line_start", "line_end", "complexity", "parent_id", "namespace", "code", "calls", "imports"]
NODE_COLUMNS = ["name", "label", "namespace", "file_path", "language", "complexity"]
EDGE_COLUMNS = ["call_count", "is_recursive", "import_type", "dependency_type", "order_no"]


def loaded(df: DataFrame, *columns: str) -> Column:
    """When a row was loaded: the first of the columns that the table has and that can be read, else null."""
    return F.coalesce(*[iso_ts(c) for c in columns if c in df.columns], F.lit(None).cast("timestamp"))


def last_load(rows: DataFrame, key: list[str], columns: list[str], at: Column) -> DataFrame:
    """One row per key: the whole row of the last load, as a merge leaves it. A null time comes before all others; rows of
    one time go by their columns, the greatest stays."""
    last = rows.groupBy(*key).agg(F.max(F.struct(at.alias("_at"), *columns)).alias("_r"))
    return last.select(*key, *[F.col("_r")[c].alias(c) for c in columns])


def units(spark: SparkSession, d: str) -> DataFrame:
    """One row per code unit id, that of its last load; kept by type and sorted by namespace and file."""
    def build() -> DataFrame:
        u = table(spark, d, "code_unit").where("id is not null").withColumn("id", norm_id("id"))
        return last_load(u, ["id"], UNIT_COLUMNS, loaded(u, "created_at"))

    return store.derived(spark, d, "units", ["code_unit"], build, ["type"], ["namespace", "file_path", "id"]).select("id", *UNIT_COLUMNS)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, label, namespace, file_path, language, complexity) of units, graph nodes and library symbols, of an id the
    last load; kept by label and sorted by namespace. Edges know ids alone, so an id is one node whatever its namespace."""
    def build() -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        u, g = table(spark, d, "code_unit"), table(spark, d, "graph_node")
        u = u.select(norm_id("id").alias("id"), "name", F.col("type").alias("label"), "namespace", "file_path", "language", "complexity", loaded(u, "created_at").alias("at"))
        g = g.select(norm_id("id").alias("id"), "name", "label", "namespace", "file_path", none("string").alias("language"), none("int").alias("complexity"), loaded(g, "updated_at", "created_at").alias("at"))
        s = table(spark, d, "external_symbol").select(norm_id("symbol_id").alias("id"), F.col("symbol").alias("name"), F.lit("Symbol").alias("label"), none("string").alias("namespace"), none("string").alias("file_path"), "language", none("int").alias("complexity"), none("timestamp").alias("at"))
        return last_load(u.unionByName(g).unionByName(s).where("id is not null"), ["id"], NODE_COLUMNS, F.col("at"))

    return store.derived(spark, d, "nodes", ["code_unit", "graph_node", "external_symbol"], build, ["label"], ["namespace", "id"]).select("id", *NODE_COLUMNS)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, type, call_count, is_recursive, import_type, dependency_type, order_no): one edge per ends and type, that of
    the last load; kept by type and sorted by source. An empty type is none."""
    def build() -> DataFrame:
        kind = F.nullif(F.upper(F.btrim("type", F.lit(" \t\r\n"))), F.lit(""))
        e = table(spark, d, "graph_edge")
        e = e.select(norm_id("from_id").alias("src"), norm_id("to_id").alias("dst"), kind.alias("type"), *EDGE_COLUMNS, loaded(e, "created_at").alias("at"))
        return last_load(e.where("src is not null and dst is not null"), ["src", "dst", "type"], EDGE_COLUMNS, F.col("at"))

    return store.derived(spark, d, "edges", ["graph_edge"], build, ["type"], ["src", "dst"]).select("src", "dst", "type", *EDGE_COLUMNS)


def service(namespace: str | Column = "namespace") -> Column:
    """The part of root:service behind the colon, empty without one."""
    return F.split_part(F.col(namespace) if isinstance(namespace, str) else namespace, F.lit(":"), F.lit(2))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of execution flows: an order is a flow, its lines are the steps, numbered by place; time is the quantity.

    A step depends on the one before (return flag A), on the two before (R) or on none (N). Numbered once and kept by flow.
    """
    return store.derived(spark, d, "steps", ["lineitem"], lambda: _steps(spark, d), [], ["flow_id", "step"])


def _steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_id"), F.row_number().over(order).alias("step"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("minutes"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    n = F.col("step")
    deps = F.when(F.col("flag") == "A", F.array(n - 1)).when(F.col("flag") == "R", F.array(n - 2, n - 1)).otherwise(F.array().cast("array<int>"))
    return s.withColumn("depends_on", F.filter(deps, lambda x: x >= 1))


def graph_steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(flow_id, step, minutes, depends_on) and (flow_id, step, other) of the graph's own flows: steps that a flow contains
    or that are part of it, numbered by their step_number, with their dependencies and parallel steps within the flow.
    Steps bear no time in the graph and count as one minute."""
    e = edges(spark, d)
    number = table(spark, d, "graph_node").where("label = 'Step' and step_number is not null").groupBy(norm_id("id").alias("id")).agg(F.max("step_number").alias("step"))
    flows = nodes(spark, d).where("label = 'ExecutionFlow'").select(F.col("id").alias("flow_id"))
    inside = e.where("type = 'CONTAINS'").select(F.col("src").alias("flow_id"), F.col("dst").alias("id")).unionByName(e.where("type in ('PART_OF', 'BELONGS_TO')").select(F.col("dst").alias("flow_id"), F.col("src").alias("id")))
    of = inside.join(flows, "flow_id", "left_semi").distinct().join(number, "id")

    def linked(kind: str) -> DataFrame:
        pair = e.where(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias("_other"))
        return of.join(pair, "id").join(of.select("flow_id", F.col("id").alias("_other"), F.col("step").alias("other")), ["flow_id", "_other"]).select("flow_id", "step", "other").distinct()

    deps = linked("DEPENDS_ON").groupBy("flow_id", "step").agg(F.array_sort(F.collect_set("other")).alias("depends_on"))
    steps = of.select("flow_id", "step").distinct().join(deps, ["flow_id", "step"], "left").select("flow_id", "step", F.lit(1.0).alias("minutes"), F.coalesce("depends_on", F.array().cast("array<int>")).alias("depends_on"))
    par = linked("PARALLEL_WITH")
    return steps, par.unionByName(par.select("flow_id", F.col("other").alias("step"), F.col("step").alias("other"))).distinct()


def parallel_pairs(s: DataFrame) -> DataFrame:
    """(flow_id, step, other) both ways: neighbouring steps without dependencies and of equal status can run together."""
    w = Window.partitionBy("flow_id").orderBy("step")
    free = F.col("flag") == "N"
    after = s.withColumn("other", F.lead("step").over(w)).withColumn("ok", free & (F.lead("flag").over(w) == "N") & (F.lead("status").over(w) == F.col("status"))).where("ok")
    pairs = after.select("flow_id", "step", "other")
    return pairs.unionByName(pairs.select("flow_id", F.col("other").alias("step"), F.col("step").alias("other")))
