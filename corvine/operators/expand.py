"""Bounded multi-hop expansion over edges: trails, reachable sets and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import cut, union_all


def _hops(edges: DataFrame, direction: str) -> DataFrame:
    eid = F.xxhash64("src", "dst", "type") if "type" in edges.columns else F.xxhash64("src", "dst")
    out = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), eid.alias("_e"))
    back = out.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_e")
    return {"out": out, "in": back, "both": out.unionByName(back.where("_a <> _b"))}[direction]


def trails(edges: DataFrame, starts: DataFrame, depth: int | None, direction: str = "out") -> DataFrame:
    """(start, node, depth, path): all trails of 1..depth hops; no edge is used twice, nodes may recur.

    ``starts`` has a column ``start``. An unrolled frontier: each level is one join on the node it stands at. Without a
    depth each level is checkpointed, and the last is the one that is empty.
    """
    hops = _hops(edges, direction)
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.array().cast("array<bigint>").alias("_trail"))
    levels = []
    while depth is None or len(levels) < depth:
        front = front.join(hops, F.col("node") == F.col("_a")).where(~F.array_contains("_trail", F.col("_e"))).select(
            "start", F.col("_b").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("_b")).alias("path"), F.array_append("_trail", F.col("_e")).alias("_trail")
        )
        front = cut(front) if depth is None else front
        levels.append(front.drop("_trail"))
        if depth is None and front.isEmpty():
            break
    return union_all(levels)


def subgraph(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth, trails, types): all nodes within ``depth`` hops either way over edges of any type, with the least
    distance, the number of trails and the sorted distinct types on all of them."""
    eid = F.xxhash64("src", "dst", "type")
    out = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), eid.alias("_e"), F.col("type").alias("_t"))
    hops = out.unionByName(out.where("_a <> _b").select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_e", "_t"))
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("_types"), F.array().cast("array<bigint>").alias("_trail"))
    levels = []
    for _ in range(depth):
        front = front.join(hops, F.col("node") == F.col("_a")).where(~F.array_contains("_trail", F.col("_e"))).select(
            "start", F.col("_b").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("_types", F.col("_t")).alias("_types"), F.array_append("_trail", F.col("_e")).alias("_trail")
        )
        levels.append(front.groupBy("start", "node", "depth", F.array_sort(F.array_distinct("_types")).alias("_types")).agg(F.count("*").alias("trails")))
    got = union_all(levels)
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_types")))), ",")
    return got.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.sum("trails").alias("trails"), types.alias("types"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(start, node, depth, path): every node within ``depth`` hops once, at its least distance, by the smallest path.

    Set semantics: levels are made distinct and lose what was seen before, so rows stay below starts x nodes. The start
    itself is at distance 0. Each level is checkpointed, as it is read by all later ones.
    """
    hops = _hops(edges, direction).select("_a", "_b").distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path")).distinct()
    front = seen
    for k in range(1, depth + 1):
        step = front.join(hops, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node"), F.lit(k).alias("depth"), F.array_append("path", F.col("_b")).alias("path"))
        step = step.groupBy("start", "node", "depth").agg(F.min("path").alias("path")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = cut(step.select("start", "node", "depth", "path"))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 5, direction: str = "both") -> DataFrame:
    """(start, target, depth, path) of one shortest path per pair, the smallest among equals; no row without a path."""
    got = reach(edges, pairs.select("start").distinct(), depth, direction)
    return pairs.join(got.withColumnRenamed("node", "target"), ["start", "target"])
