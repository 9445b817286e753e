"""Execution flows: parallel groups, critical path, speedup and recommendations, for all flows at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import cut, small

#: Flows of more steps than this are solved by joins instead of within a row.
LARGE_FLOW = 10_000


def same_dependency_groups(steps: DataFrame) -> DataFrame:
    """(flow_id, deps, steps, n): steps of a flow with the same dependencies, two or more."""
    g = steps.groupBy("flow_id", F.array_join(F.array_sort("depends_on"), ",").alias("deps")).agg(F.array_sort(F.collect_list("step")).alias("members"))
    return g.where(F.size("members") > 1).select("flow_id", "deps", F.array_join("members", ",").alias("steps"), F.size("members").alias("n"), "members")


def parallel_with(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(flow_id, step, others): per step those it can run with; steps without any are left out."""
    return pairs.groupBy("flow_id", "step").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


def all_groups(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """groups by equal dependencies and each step with its parallel ones, without repeats."""
    a = same_dependency_groups(steps).select("flow_id", "members")
    b = pairs.groupBy("flow_id", "step").agg(F.collect_set("other").alias("o")).select("flow_id", F.array_sort(F.array_distinct(F.concat("o", F.array("step")))).alias("members"))
    return a.unionByName(b).distinct()


def speedup(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """sequential minutes, minutes saved by the groups, what is left, and their ratio (1 when nothing is left)."""
    g = groups.withColumn("_g", F.xxhash64("flow_id", "members")).select("flow_id", "_g", F.explode("members").alias("step"))
    saved = g.join(steps.select("flow_id", "step", "minutes"), ["flow_id", "step"]).groupBy("flow_id", "_g").agg((F.sum("minutes") - F.max("minutes")).alias("s")).groupBy("flow_id").agg(F.sum("s").alias("saved"))
    total = steps.groupBy("flow_id").agg(F.sum("minutes").alias("sequential"))
    x = total.join(saved, "flow_id", "left").select("flow_id", "sequential", F.coalesce("saved", F.lit(0.0)).alias("saved"))
    left = F.col("sequential") - F.col("saved")
    return x.select("flow_id", "sequential", "saved", left.alias("parallel"), F.round(F.when(left > 0, F.col("sequential") / left).otherwise(1.0), 6).alias("speedup"))


def longest(numbers: list[int], minutes: list[float], deps: list[list[int]]) -> tuple[float | None, list[int]]:
    """The longest chain of minutes and its steps; a dependency on no step is ignored, the smallest step wins ties, and a
    cycle gives no time. Steps without a time take one minute."""
    cost = {s: (m or 1.0) for s, m in zip(numbers, minutes, strict=True)}
    need = {s: sorted(x for x in set(d) if x in cost) for s, d in zip(numbers, deps, strict=True)}
    left = {s: len(d) for s, d in need.items()}
    after: dict[int, list[int]] = {}
    for s, d in need.items():
        for x in d:
            after.setdefault(x, []).append(s)
    ready, finish, prev, n = sorted(s for s, k in left.items() if not k), {}, {}, 0
    while ready:
        s = ready.pop()
        n += 1
        best = max(need[s], key=lambda x: (finish[x], -x), default=None)
        finish[s], prev[s] = cost[s] + (finish[best] if best is not None else 0.0), best
        for t in after.get(s, []):
            left[t] -= 1
            if not left[t]:
                ready.append(t)
    if n < len(cost) or not cost:
        return None, []
    at: int | None = max(finish, key=lambda x: (finish[x], -x))
    total, path = finish[at], []
    while at is not None:
        path.append(at)
        at = prev[at]
    return total, path[::-1]


def critical_paths(steps: DataFrame) -> DataFrame:
    """(flow_id, critical_time, critical_path) of every flow; null time for a flow with a cycle.

    The steps of a flow with up to LARGE_FLOW of them become one row (partial collects on the JVM side), and rows are solved
    in batches; larger flows are solved step by step with joins, so no flow has to fit a task.
    """
    kind = steps.schema["flow_id"].dataType.simpleString()
    large = cut(steps.groupBy("flow_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_FLOW).select("flow_id"))
    if large.isEmpty():
        return _in_rows(steps, kind)
    large = small(large)
    return _in_rows(steps.join(large, "flow_id", "left_anti"), kind).unionByName(_by_joins(steps.join(large, "flow_id", "left_semi")))


def _in_rows(steps: DataFrame, kind: str) -> DataFrame:
    rows = steps.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("step", "minutes", "depends_on"))).alias("s"))
    rows = rows.select("flow_id", F.col("s.step").alias("n"), F.col("s.minutes").alias("m"), F.col("s.depends_on").alias("d"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [longest(list(n), list(m), [list(x) for x in d]) for n, m, d in zip(b["n"], b["m"], b["d"], strict=True)]
            yield pd.DataFrame({"flow_id": b["flow_id"], "critical_time": [t for t, _ in got], "critical_path": [",".join(map(str, p)) for _, p in got]})

    return rows.mapInPandas(solve, f"flow_id {kind}, critical_time double, critical_path string")


def _by_joins(steps: DataFrame) -> DataFrame:
    """As longest, for all flows at once: a round finishes the steps whose dependencies are finished; then the path is walked
    back. There are as many rounds as steps in the longest chain."""
    key = ["flow_id", "step"]
    s = cut(steps.select(*key, F.coalesce(F.nullif("minutes", F.lit(0.0)), F.lit(1.0)).alias("cost"), "depends_on"))
    need = cut(s.select(*key, F.explode(F.array_distinct("depends_on")).alias("dep")).join(s.select("flow_id", F.col("step").alias("dep")), ["flow_id", "dep"]))
    front = cut(s.join(need, key, "left_anti").select(*key, F.col("cost").alias("finish"), F.lit(None).cast(s.schema["step"].dataType).alias("prev")))
    done = front
    while not front.isEmpty():
        touched = need.join(front.select("flow_id", F.col("step").alias("dep")), ["flow_id", "dep"]).select(*key).distinct()
        known = done.select("flow_id", F.col("step").alias("dep"), "finish")
        state = need.join(touched, key).join(known, ["flow_id", "dep"], "left").groupBy(*key).agg(F.count("*").alias("_n"), F.count("finish").alias("_k"), F.max(F.struct("finish", (-F.col("dep")).alias("_dep"))).alias("_b"))
        front = cut(state.where("_n = _k").join(s, key).select(*key, (F.col("_b.finish") + F.col("cost")).alias("finish"), (-F.col("_b._dep")).alias("prev")))
        done = done.unionByName(front)
    done = cut(done)
    total = s.groupBy("flow_id").agg(F.count("*").alias("_n")).join(done.groupBy("flow_id").agg(F.count("*").alias("_k"), F.max(F.struct("finish", (-F.col("step")).alias("_step"))).alias("_e")), "flow_id", "left")
    ends = total.where("_n = _k").select("flow_id", F.col("_e.finish").alias("critical_time"), (-F.col("_e._step")).alias("step"))
    walk = cut(ends.join(done, key).select(*key, "prev", F.lit(0).alias("back")))
    path = walk
    while not walk.isEmpty():
        walk = cut(walk.where("prev is not null").select("flow_id", F.col("prev").alias("step"), (F.col("back") + 1).alias("back")).join(done.select(*key, "prev"), key).select(*key, "prev", "back"))
        path = path.unionByName(walk)
    texts = path.groupBy("flow_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("back", "step")))), lambda x: x["step"].cast("string")), ",").alias("critical_path"))
    return total.select("flow_id").join(ends.select("flow_id", "critical_time"), "flow_id", "left").join(texts, "flow_id", "left").select("flow_id", "critical_time", F.coalesce("critical_path", F.lit("")).alias("critical_path"))


#: Lines of advice.
ADVICE = {
    "found": "Found %d parallelization opportunities that could provide %.2fx speedup", "group": "Parallel Group %d: %s can run concurrently", "path": "Critical path contains %d steps: %s",
    "focus": "Focus optimization efforts on critical path steps for maximum impact", "async": "%d async steps could benefit from concurrent execution", "none": "No parallelization opportunities detected - execution is mostly sequential",
}


def recommendations(speed: DataFrame, groups: DataFrame, critical: DataFrame, asynchronous: DataFrame | None = None) -> DataFrame:
    """lines of advice per flow, in a fixed order: its parallel groups and gain, each group, its critical path, its
    asynchronous steps (flow_id, n_async), or that it is sequential."""
    steps = lambda a: F.concat(F.lit("Step "), F.array_join(a, ", Step "))
    g = groups.groupBy("flow_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("members")).alias("_g"))
    x = speed.join(g, "flow_id", "left").join(critical, "flow_id", "left")
    x = x.join(asynchronous, "flow_id", "left") if asynchronous is not None else x.withColumn("n_async", F.lit(0))
    some, path = F.col("n") > 0, F.split("critical_path", ",")
    each = F.transform("_g", lambda m, i: F.format_string(ADVICE["group"], i + 1, steps(m)))
    return x.select(
        "flow_id",
        F.concat_ws(
            "\n",
            F.when(some, F.format_string(ADVICE["found"], "n", "speedup")),
            F.when(some, F.array_join(each, "\n")),
            F.when(F.length("critical_path") > 0, F.format_string(ADVICE["path"], F.size(path), steps(path))),
            F.when(F.length("critical_path") > 0, ADVICE["focus"]),
            F.when(F.col("n_async") > 0, F.format_string(ADVICE["async"], "n_async")),
            F.when(~F.coalesce(some, F.lit(False)), ADVICE["none"]),
        ).alias("advice"),
    )


def analyze(steps: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per flow: total_steps, groups, critical time and path, times, speedup and advice; per step: whether it lies on the
    critical path). Flows without steps have no rows."""
    g, crit = all_groups(steps, pairs), critical_paths(steps)
    speed = speedup(steps, g)
    flows = (
        steps.groupBy("flow_id").agg(F.count("*").alias("total_steps")).join(g.groupBy("flow_id").agg(F.count("*").alias("parallel_groups")), "flow_id", "left")
        .join(crit, "flow_id").join(speed, "flow_id").join(recommendations(speed, g, crit), "flow_id").withColumn("parallel_groups", F.coalesce("parallel_groups", F.lit(0)))
    )
    marked = steps.join(crit, "flow_id").select("flow_id", "step", F.array_contains(F.split("critical_path", ","), F.col("step").cast("string")).alias("is_critical_path"))
    return flows, marked
