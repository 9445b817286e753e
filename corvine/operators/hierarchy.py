"""Parent-child links to full hierarchies: path, depth, root and descendants of every node, cycles apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.common import HOT_LEAST, cut, hot_keys, norm_id, salted_lookup

#: Types whose links run from parent to child, and from child to parent.
PARENT_TO_CHILD = ("contains", "has_section")
CHILD_TO_PARENT = ("part_of", "belongs_to")
#: One node in so many is a splitter (by its hash), besides every root and every hot parent.
SPLIT_EVERY = 4


def parent_pointers(edges: DataFrame) -> DataFrame:
    """(node, parent): one row per id at either end of a hierarchical link; the parent of a root is null.

    Ids and types are compared trimmed and lower-cased; repeated links and the same link told both ways count once. A
    null or empty end is no id; the other end still becomes a node. Of several parents the smallest is kept;
    other_parents reports the rest.
    """
    return _links(edges).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))


def other_parents(edges: DataFrame) -> DataFrame:
    """(node_id, parent_id): links to further parents of nodes that have several, which no tree can hold."""
    links = _links(edges).where("node is not null and parent is not null").distinct()
    kept = links.groupBy("node").agg(F.min("parent").alias("parent"), F.count("*").alias("_n")).where("_n > 1").select("node", F.col("parent").alias("_kept"))
    return links.join(kept, "node").where("parent <> _kept").select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"))


def _links(edges: DataFrame) -> DataFrame:
    """(node, parent) of every hierarchical link, and (parent, null)."""
    kind, a, b = norm_id("type"), F.nullif(norm_id("from_id"), F.lit("")), F.nullif(norm_id("to_id"), F.lit(""))
    up = kind.isin(*CHILD_TO_PARENT)
    links = edges.where(kind.isin(*PARENT_TO_CHILD, *CHILD_TO_PARENT)).select(F.when(up, a).otherwise(b).alias("child"), F.when(up, b).otherwise(a).alias("parent"))
    ends = links.select(F.explode(F.array(F.struct(F.col("child").alias("node"), "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))).alias("e"))
    return ends.select("e.node", "e.parent")


def _jump(walk: DataFrame, key_paths: bool, salt: bool, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Let every open row of (node, cur, dist, done[, path]) jump on until its pointer is done.

    Pointers double each round, so the rounds are the logarithm of the longest walk. Returns the finished rows and those
    that never finish: with f the pointer map, the sets of open targets of f^1, f^2, f^4... are nested, so once their
    size stays the same the rest turns around on cycles, and ``cur`` of the rest is exactly the nodes on those cycles.
    asked: which rows can be asked for their pointer at all.
    """
    parts = int(walk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finished, last = walk.where("done"), None
    active = walk.where("not done")
    while True:
        rows, n = active.agg(F.count("*"), F.count_distinct("cur")).first()
        if n == 0 or n == last:
            return finished, active
        last = n
        cols = [F.col("node").alias("_n"), F.col("cur").alias("_cur"), F.col("dist").alias("_dist"), F.col("done").alias("_done"), *([F.col("path").alias("_path")] if key_paths else [])]
        table = finished.unionByName(active).coalesce(parts)
        table = (table if asked is None else table.where(asked)).select(*cols).withColumnRenamed("_n", "_key")
        step = active.withColumnRenamed("cur", "_key")
        step = salted_lookup(step, table, "_key", "inner") if salt and rows > HOT_LEAST else step.join(table, "_key")
        step = cut(step.select(
            "node", F.col("_cur").alias("cur"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done"),
            *([F.concat("path", "_path").alias("path")] if key_paths else []),
        ))
        # Unions of rounds would pile up partitions, most of them small.
        finished, active = finished.unionByName(step.where("done")).coalesce(parts), step.where("not done")


def hierarchy(edges: DataFrame, paths: bool = False, split_every: int = SPLIT_EVERY) -> DataFrame:
    """(node_id, root_id, node_depth[, path]) of every node of the hierarchical links.

    Deterministic hash splitters (and roots, and parents of very many children, so that no hot id is walked through) cut
    the trees into short walks; every node walks to its next splitter, the reduced graph of splitters alone is solved by
    pointer jumping, and both parts are put together into exact roots, depths and paths. A root is its own root at depth
    0. A node on a cycle has root ``cycle`` and depth -1, a node below one ``cycle`` and -2; a link from a node to itself
    is a cycle. ``path`` is the array of ids from the root to the node, null for cyclic nodes. Empty links, no rows.
    """
    pointers = cut(parent_pointers(edges))
    hot = F.broadcast(cut(hot_keys(pointers, "parent").select(F.col("parent").alias("_hot"))))
    chosen = lambda c: F.pmod(F.xxhash64(c), F.lit(split_every)) == 0
    seed = (
        pointers.join(hot.withColumn("_hot_node", F.lit(True)), F.col("node") == F.col("_hot"), "left").drop("_hot")
        .join(hot.withColumn("_hot_parent", F.lit(True)), F.col("parent") == F.col("_hot"), "left")
        .select(
            "node", "parent",
            (F.col("parent").isNull() | chosen("node") | F.col("_hot_node").isNotNull()).alias("splitter"),
            (F.coalesce(chosen("parent"), F.lit(False)) | F.col("_hot_parent").isNotNull()).alias("below_splitter"),
        )
    )

    # Walks. A splitter stands at itself; any other node takes its first step to its parent. A parent that is a splitter
    # by its hash or its many children is known as one without a lookup, so no walk ever looks up a hot id.
    keep = lambda c: [c.alias("path")] if paths else []
    start = seed.select(
        "node",
        F.when(F.col("splitter"), F.col("node")).otherwise(F.col("parent")).alias("cur"),
        F.when(F.col("splitter"), 0).otherwise(1).alias("dist"),
        (F.col("splitter") | F.col("below_splitter")).alias("done"),
        *keep(F.when(F.col("splitter"), F.array().cast("array<string>")).otherwise(F.array("parent"))),
    )
    walked, looping = _jump(start, paths, salt=False, asked=~chosen("node"))

    # Reduced graph: splitter -> splitter above the parent; roots are its ends.
    roots = seed.where("parent is null")
    above = seed.where("splitter and parent is not null")
    direct = above.where("below_splitter").select("node", F.col("parent").alias("cur"), F.lit(1).alias("dist"), F.lit(False).alias("done"), *keep(F.array("parent")))
    cols = [F.col("node").alias("_key"), F.col("cur").alias("_cur"), F.col("dist").alias("_dist"), *([F.col("path").alias("_path")] if paths else [])]
    lifted = above.where("not below_splitter").select(F.col("node").alias("_s"), F.col("parent").alias("_key")).join(walked.select(*cols), "_key", "left")
    lifted = lifted.select(
        F.col("_s").alias("node"), F.col("_cur").alias("cur"), (F.col("_dist") + 1).alias("dist"), F.lit(False).alias("done"),
        *([F.concat(F.array("_key"), "_path").alias("path")] if paths else []),
    )
    lifted = cut(direct.unionByName(lifted))
    ends = roots.select("node", F.col("node").alias("cur"), F.lit(0).alias("dist"), F.lit(True).alias("done"), *keep(F.array().cast("array<string>")))
    solved, turning = _jump(ends.unionByName(lifted.where("cur is not null")), paths, salt=True)

    # Cycles: the targets of the rows that never finish, and on cycles with splitters the walks between them.
    on_split = turning.select(F.col("cur").alias("node")).distinct()
    ring = lifted.join(on_split, "node", "left_semi").select("node", "cur")
    between = _walk_between(seed, ring)
    on_cycle = on_split.unionByName(between).unionByName(looping.select(F.col("cur").alias("node"))).distinct()

    # A splitter whose parent walks into a loop without splitters has no reduced pointer (cur is null) and never solves.
    tops = solved.select(F.col("node").alias("_key"), F.col("cur").alias("_root"), F.col("dist").alias("_up"), *([F.col("path").alias("_above")] if paths else []))
    rows = walked.select("node", F.col("cur").alias("_key"), "dist", *(["path"] if paths else []))
    joined = salted_lookup(rows, tops, "_key", "left").join(on_cycle.withColumn("_ring", F.lit(True)), "node", "left")
    whole = F.col("_root").isNotNull()
    below = F.when(F.col("_ring"), -1).otherwise(-2)
    done = joined.select(
        F.col("node").alias("node_id"),
        F.when(whole, F.col("_root")).otherwise(F.lit("cycle")).alias("root_id"),
        F.when(whole, F.col("dist") + F.col("_up")).otherwise(below).cast("int").alias("node_depth"),
        *([F.when(whole, F.reverse(F.concat(F.array("node"), "path", "_above"))).alias("path")] if paths else []),
    )
    lost = looping.select("node").join(on_cycle.withColumn("_ring", F.lit(True)), "node", "left").select(
        F.col("node").alias("node_id"), F.lit("cycle").alias("root_id"), below.cast("int").alias("node_depth"),
        *([F.lit(None).cast("array<string>").alias("path")] if paths else []),
    )
    return done.unionByName(lost)


def _walk_between(seed: DataFrame, ring: DataFrame) -> DataFrame:
    """Nodes passed on the way from each splitter on a cycle to the next one: only these few walks are taken step by step."""
    front = cut(ring.join(seed.select("node", F.col("parent").alias("at")), "node").where("at <> cur").select("at", "cur"))
    found = [front.select(F.col("at").alias("node"))]
    while not front.isEmpty():
        front = cut(front.join(seed.select(F.col("node").alias("at"), F.col("parent").alias("_next")), "at").where("_next <> cur").select(F.col("_next").alias("at"), "cur"))
        found.append(front.select(F.col("at").alias("node")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def closure(paths: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for all true ancestors, from the paths; rows grow with nodes x depth."""
    up = paths.where("node_depth > 0").select("node_id", "node_depth", F.posexplode("path").alias("_at", "ancestor_id")).where("_at < node_depth")
    return up.select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("node_depth") - F.col("_at")).alias("distance"))


def descendants(paths: DataFrame) -> DataFrame:
    """(node_id, n_descendants, n_children, max_height) of every node on no cycle; leaves have zeros.

    Counted from the closure with partial aggregation, so a root above a third of all nodes is no hot group.
    """
    counts = closure(paths).groupBy(F.col("ancestor_id").alias("node_id")).agg(
        F.count("*").alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"), F.max("distance").alias("max_height")
    )
    return paths.where("node_depth >= 0").select("node_id").join(counts, "node_id", "left").select(
        "node_id", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("max_height", F.lit(0)).cast("int").alias("max_height")
    )
