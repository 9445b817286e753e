"""References to records that do not exist: missing, deleted and late parents of links and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.common import iso_ts, norm_id, salted_lookup


def parent_intervals(units: DataFrame, nodes: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row per parent id with the interval of its life: ``created`` (earliest known time of a live record, null when
    unknown) and ``removed`` (latest time at which it was deleted, null if never), ``live`` (stands in units or nodes: created
    again if it was deleted), ``known`` (stands in any table but the deleted ones)."""
    flags = lambda df, col, live, known, at, end=None: df.select(norm_id(col).alias("ref"), live.alias("live"), known.alias("known"), at.alias("created"), (never if end is None else end).alias("removed"))
    yes, no, never = F.lit(True), F.lit(False), F.lit(None).cast("timestamp")
    parents = (
        flags(units, "id", yes, yes, iso_ts("created_at"))
        .unionByName(flags(nodes, "id", yes, yes, iso_ts("created_at")))
        .unionByName(flags(symbols, "symbol_id", no, yes, never))
        .unionByName(flags(deleted, "node_id", no, no, never, F.col("deleted_at").cast("timestamp") if "deleted_at" in deleted.columns else never))
    )
    return parents.where("ref is not null").groupBy("ref").agg(F.max("live").alias("live"), F.max("known").alias("known"), F.min("created").alias("created"), F.max("removed").alias("removed"))


def orphan_links(edges: DataFrame, units: DataFrame, nodes: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orphan ``to_id`` of the links: (ref_key, target_ref, orphan_kind, at, removed), removed: the end of its parent's life.

    References and parent intervals are co-partitioned and sorted on the id and merged in one pass; hot ids (a library
    symbol may hold a third of all links) are salted. ``missing``: in no table; ``deleted``: only in the deleted ones;
    ``late``: live, but its earliest known time lies after that of the link. A null or unreadable time on either side is
    not late; a null ``to_id`` refers to nothing and is no reference. Repeated links count each under their own key.
    """
    refs = edges.where("to_id is not null").select(F.col("edge_key").cast("string").alias("ref_key"), norm_id("to_id").alias("ref"), iso_ts("created_at").alias("at"))
    merged = salted_lookup(refs, parent_intervals(units, nodes, symbols, deleted), "ref")
    kind = (
        F.when(F.col("known").isNull(), "missing")
        .when(~F.col("known"), "deleted")
        .when(F.col("live") & (F.col("created") > F.col("at")), "late")
    )
    return merged.select("ref_key", F.col("ref").alias("target_ref"), kind.alias("orphan_kind"), "at", "removed").where("orphan_kind is not null")


def _place() -> Column:
    """Namespace and name as one key; a null namespace is one of its own."""
    return F.concat(F.coalesce(F.concat(F.lit("="), "namespace"), F.lit("")), F.lit("\x01"), "name")


def orphan_calls(units: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orphan elements of ``calls``: (ref_key, target_ref, orphan_kind, at), once per unit id and element.

    An element that is a known library symbol exists; else the part after its last dot must be the name of a unit in the
    same namespace, else it is ``deleted`` if a deleted record has that name there, else ``missing``. Null elements and
    null or empty lists refer to nothing; ``at`` is the earliest known time of the unit's rows.

    Calls are first reduced to distinct (unit, element) pairs and then to distinct (namespace, name) pairs, so a name
    called by everyone is judged once, and its verdict is joined back salted. A unit loaded under several namespaces is resolved if one of them resolves it.
    """
    calls = units.select(F.col("id").alias("ref_key"), "namespace", F.explode("calls").alias("target_ref"), iso_ts("created_at").alias("at")).where("target_ref is not null and ref_key is not null")
    calls = calls.groupBy("ref_key", "namespace", "target_ref").agg(F.min("at").alias("at"))
    known = symbols.select(F.col("symbol").alias("target_ref")).where("target_ref is not null").distinct()
    calls = calls.join(known, "target_ref", "left_anti").withColumn("name", F.substring_index("target_ref", ".", -1))
    asked = calls.select("namespace", "name", F.lit(True).alias("asked"), F.lit(False).alias("unit"), F.lit(False).alias("gone"))
    there = units.select("namespace", "name", F.lit(False).alias("asked"), F.lit(True).alias("unit"), F.lit(False).alias("gone"))
    gone = deleted.select("namespace", "name", F.lit(False).alias("asked"), F.lit(False).alias("unit"), F.lit(True).alias("gone"))
    verdict = (
        asked.unionByName(there).unionByName(gone)
        .groupBy("namespace", "name").agg(*[F.max(c).alias(c) for c in ("asked", "unit", "gone")])
        .where("asked and not unit")
        .select(_place().alias("_place"), "gone")
    )
    judged = salted_lookup(calls.withColumn("_place", _place()), verdict, "_place")
    return (
        judged.groupBy("ref_key", "target_ref")
        .agg(F.min(F.col("gone").isNotNull()).alias("orphan"), F.max("gone").alias("gone"), F.min("at").alias("at"))
        .where("orphan")
        .select("ref_key", "target_ref", F.when(F.col("gone"), "deleted").otherwise("missing").alias("orphan_kind"), "at")
    )


def orphan_references(edges: DataFrame, units: DataFrame, nodes: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """All orphan references of both tables: (ref_table, ref_key, target_ref, orphan_kind, at). See the two parts."""
    links = orphan_links(edges, units, nodes, symbols, deleted).drop("removed").withColumn("ref_table", F.lit("graph_edge"))
    calls = orphan_calls(units, symbols, deleted).withColumn("ref_table", F.lit("code_unit"))
    return links.unionByName(calls).select("ref_table", "ref_key", "target_ref", "orphan_kind", "at")


def references_to_deleted(edges: DataFrame, units: DataFrame, nodes: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """(ref_key, target_ref, removed, after) of the links to deleted records: when the record was deleted last, and whether
    the link was made after that (null when its time is unknown)."""
    links = orphan_links(edges, units, nodes, symbols, deleted).where("orphan_kind = 'deleted'")
    return links.select("ref_key", "target_ref", "removed", (F.col("at") > F.col("removed")).alias("after"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Numbers per table, month of the referring row (null when its time is unknown) and kind."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "orphan_kind").agg(F.count("*").alias("orphans"))
