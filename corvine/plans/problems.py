"""Queries of the general data-quality problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvine.common import cut, table
from corvine.operators import hierarchy, references


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("graph_edge", "code_unit", "graph_node", "external_symbol", "deleted_node")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of graph_edge.to_id and code_unit.calls."""
    return references.orphan_references(*_tables(spark, d)).drop("at")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month of the referring row and kind."""
    return references.orphan_report(references.orphan_references(*_tables(spark, d)))


def p5_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Links to deleted records, with the end of the record's life and whether the link is younger."""
    return references.references_to_deleted(*_tables(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node of the hierarchical edges."""
    return hierarchy.hierarchy(table(spark, d, "graph_edge"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, with the path of ids from the root, joined by slashes."""
    return hierarchy.hierarchy(table(spark, d, "graph_edge"), paths=True).selectExpr("node_id", "root_id", "node_depth", "array_join(path, '/') AS path")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of descendants and children and the height of every node that has a root."""
    return hierarchy.descendants(cut(hierarchy.hierarchy(table(spark, d, "graph_edge"), paths=True)))


def p6_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every true ancestor and descendant with their distance."""
    return hierarchy.closure(hierarchy.hierarchy(table(spark, d, "graph_edge"), paths=True))


def p6_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to further parents, which the tree leaves out."""
    return hierarchy.other_parents(table(spark, d, "graph_edge"))


QUERIES = {f.__name__: f for f in (p5_found, p5_report, p5_deleted, p6_found, p6_paths, p6_descendants, p6_closure, p6_other_parents)}

_B = "E' \\t\\r\\n'"
_TS = f"try_cast(CASE WHEN regexp_matches(trim(created_at, {_B}), '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN trim(created_at, {_B}) ELSE trim(created_at, {_B}) || 'Z' END AS TIMESTAMPTZ)"
_ORPHANS = f"""
WITH unit AS (SELECT lower(trim(id, {_B})) AS ref, {_TS} AS tm FROM code_unit),
node AS (SELECT lower(trim(id, {_B})) AS ref, {_TS} AS tm FROM graph_node),
live AS (SELECT ref, min(tm) AS born FROM (SELECT * FROM unit UNION ALL SELECT * FROM node) GROUP BY ref),
ext AS (SELECT DISTINCT lower(trim(symbol_id, {_B})) AS ref FROM external_symbol),
gone AS (SELECT DISTINCT lower(trim(node_id, {_B})) AS ref FROM deleted_node),
link AS (SELECT CAST(edge_key AS VARCHAR) AS ref_key, lower(trim(to_id, {_B})) AS ref, {_TS} AS tm FROM graph_edge WHERE to_id IS NOT NULL),
links AS (SELECT 'graph_edge' AS ref_table, ref_key, link.ref AS target_ref,
  CASE WHEN live.ref IS NOT NULL THEN CASE WHEN live.born > link.tm THEN 'late' END WHEN ext.ref IS NOT NULL THEN NULL WHEN gone.ref IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind, link.tm AS tm
  FROM link LEFT JOIN live ON live.ref = link.ref LEFT JOIN ext ON ext.ref = link.ref LEFT JOIN gone ON gone.ref = link.ref),
call AS (SELECT id AS ref_key, namespace, el AS target_ref, split_part(el, '.', -1) AS name, min(tm) AS tm FROM
  (SELECT id, namespace, unnest(calls) AS el, {_TS} AS tm FROM code_unit) WHERE el IS NOT NULL GROUP BY ALL),
calls AS (SELECT 'code_unit' AS ref_table, ref_key, target_ref,
  CASE WHEN EXISTS (SELECT 1 FROM deleted_node g WHERE g.name = call.name AND g.namespace = call.namespace) THEN 'deleted' ELSE 'missing' END AS orphan_kind, tm
  FROM call WHERE target_ref NOT IN (SELECT symbol FROM external_symbol) AND NOT EXISTS (SELECT 1 FROM code_unit u WHERE u.name = call.name AND u.namespace = call.namespace)),
orphan AS (SELECT * FROM links WHERE orphan_kind IS NOT NULL UNION ALL SELECT * FROM calls)
"""
_TREE = f"""
WITH RECURSIVE link AS (SELECT CASE WHEN k IN ('part_of', 'belongs_to') THEN a ELSE b END AS child, CASE WHEN k IN ('part_of', 'belongs_to') THEN b ELSE a END AS parent FROM
  (SELECT lower(trim(type, {_B})) AS k, lower(trim(from_id, {_B})) AS a, lower(trim(to_id, {_B})) AS b FROM graph_edge) WHERE k IN ('contains', 'has_section', 'part_of', 'belongs_to')),
up AS (SELECT child, min(parent) AS parent FROM link WHERE parent IS NOT NULL GROUP BY child),
node AS (SELECT DISTINCT unnest([child, parent]) AS id FROM link),
walk AS (SELECT id AS node_id, id AS root_id, 0 AS node_depth, id AS path FROM node WHERE id NOT IN (SELECT child FROM up)
  UNION ALL SELECT up.child, walk.root_id, walk.node_depth + 1, walk.path || '/' || up.child FROM walk JOIN up ON up.parent = walk.node_id),
lost AS (SELECT id FROM node WHERE id NOT IN (SELECT node_id FROM walk)),
round AS (SELECT id AS node_id, parent AS at FROM lost JOIN up ON up.child = lost.id UNION SELECT round.node_id, up.parent FROM round JOIN up ON up.child = round.at),
tree AS (SELECT * FROM walk UNION ALL SELECT id, 'cycle', CASE WHEN EXISTS (SELECT 1 FROM round r WHERE r.node_id = id AND r.at = id) THEN -1 ELSE -2 END, NULL FROM lost),
pair AS (SELECT r.node_id AS ancestor_id, up.child AS descendant_id, 1 AS distance FROM walk r JOIN up ON up.parent = r.node_id
  UNION ALL SELECT pair.ancestor_id, up.child, pair.distance + 1 FROM pair JOIN up ON up.parent = pair.descendant_id)
"""
SQL = {
    "p5_found": _ORPHANS + "SELECT ref_table, ref_key, target_ref, orphan_kind FROM orphan",
    "p5_report": _ORPHANS + "SELECT ref_table, strftime(make_timestamp(epoch_us(tm)), '%Y-%m') AS ref_month, orphan_kind, count(*) AS orphans FROM orphan GROUP BY ALL",
    "p5_deleted": _ORPHANS + f"""SELECT ref_key, target_ref, g.removed, make_timestamp(epoch_us(tm)) > g.removed AS after FROM links JOIN (SELECT lower(trim(node_id, {_B})) AS ref, max(CAST(deleted_at AS TIMESTAMP)) AS removed FROM deleted_node GROUP BY 1) g ON g.ref = target_ref WHERE orphan_kind = 'deleted'""",
    "p6_other_parents": _TREE + "SELECT DISTINCT link.child AS node_id, link.parent AS parent_id FROM link JOIN up ON up.child = link.child WHERE link.parent <> up.parent",
    "p6_found": _TREE + "SELECT node_id, root_id, node_depth FROM tree",
    "p6_paths": _TREE + "SELECT node_id, root_id, node_depth, path FROM tree",
    "p6_descendants": _TREE + """SELECT w.node_id, count(p.descendant_id) AS n_descendants, CAST(coalesce(sum(CASE WHEN p.distance = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_children, coalesce(max(p.distance), 0) AS max_height
        FROM walk w LEFT JOIN pair p ON p.ancestor_id = w.node_id GROUP BY w.node_id""",
    "p6_closure": _TREE + "SELECT * FROM pair",
}
