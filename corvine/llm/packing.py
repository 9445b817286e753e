"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths are told apart in so many steps of the capacity at most (exactly up to this capacity, rounded up beyond), which
#: bounds the pricing program and what reaches the driver.
GRID = 8192
#: How strongly serving a length lowers its price, how much more a unit of a long item is worth than of a short one, and how
#: many of the lengths of the dearest units a round prices first.
RATE, LONG_FIRST, FIRST_PRICED = 0.5, 0.02, 96
#: So many items of one length are numbered in one task at most.
SHARE_ROWS = 1 << 20


def best_pattern(weights: np.ndarray, lengths: np.ndarray, rest: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest pattern (copies per length, none more often than it is left) that fits: the pricing problem, a bounded
    knapsack by dynamic programming over the capacity, with copies in powers of two."""
    value, taken = np.zeros(capacity + 1), []
    for i, (n, w) in enumerate(zip(lengths.tolist(), weights.tolist(), strict=True)):
        left, k = min(int(rest[i]), capacity // n), 1
        while left:
            k = min(k, left)
            more = value[: -k * n] + k * w
            better = more > value[k * n :]
            value[k * n :][better] = more[better]
            taken.append((i, k, k * n, better))
            left, k = left - k, 2 * k
    counts, c = np.zeros(len(lengths), dtype=np.int64), capacity
    for i, k, size, better in reversed(taken):
        if c >= size and better[c - size]:
            counts[i] += k
            c -= size
    return counts


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places of lengths, copies of each, containers): patterns that together hold exactly ``demand`` items of each length.

    The configuration program (fewest patterns that serve every length) by multiplicative weights: a round prices the
    lengths, finds the dearest pattern by the knapsack program and takes the largest step that serves no length beyond
    its demand, rounded down to whole containers; a length's price falls exponentially with the share of its demand that
    is served. What is left is priced anew until nothing is, so every item is placed by a pattern. A round first prices
    the lengths of the dearest units only, and all of them if no such pattern is full. Each round serves a length to its
    end, so there are no more rounds than lengths. All of it works on the histogram: data of any size cost the same.
    """
    rest = demand.astype(np.int64).copy()
    out = []
    while rest.any():
        live = np.flatnonzero(rest)
        unit = (lengths[live] / capacity) ** LONG_FIRST * np.exp(RATE * (rest[live] / demand[live] - 1))
        order = np.argsort(-unit, kind="stable")
        for some in (order[:FIRST_PRICED], order):
            at = live[some]
            p = best_pattern(unit[some] * lengths[at], lengths[at], rest[at], capacity)
            if int((p * lengths[at]).sum()) == capacity or len(at) == len(live):
                break
        used = p > 0
        times = int((rest[at][used] // p[used]).min())
        out.append((at[used], p[used], times))
        rest[at] -= p * times
    return out


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece_no, first, n, container): every item in one container, or in pieces if it alone exceeds the capacity.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed like an
    item; ``first`` and ``n`` say which of its units a piece holds. Items of no size and null sizes take no space: piece
    0 of size 0 in container 0. Ties in length are broken by the key's hash, then by place. No container holds more than
    the capacity; an empty table gives no rows.

    Only the histogram of lengths (at most GRID numbers, and one for every SHARE_ROWS items of a length) reaches the
    driver. Items are numbered within their length by two steps, per share and then by the shares' counts, so that a
    length with a third of all items is numbered in as many tasks as it needs; a piece's container follows from length
    and number alone. Capacities above GRID are measured in GRID steps, lengths rounded up.
    """
    steps = min(capacity, GRID)
    whole = sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    full = F.when(F.col("_size") > capacity, F.floor((F.col("_size") - 1) / capacity)).otherwise(0).cast("int")
    cut = whole.select("_key", "_size", F.explode(F.sequence(F.lit(0), full)).alias("piece_no"))
    pieces = cut.select(
        "_key", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first"),
        F.least(F.lit(capacity), F.col("_size") - F.col("piece_no").cast("long") * capacity).cast("int").alias("n"),
    ).withColumn("_len", F.ceil(F.col("n").cast("long") * steps / capacity).cast("int"))
    counted = pieces.where("n > 0").groupBy("_len").count().collect()  # at most GRID rows
    demand = np.zeros(steps + 1, dtype=np.int64)
    for r in counted:
        demand[r["_len"]] = r["count"]
    shares = np.maximum(1, -(-demand // SHARE_ROWS))
    first_share = np.cumsum(shares) - shares
    by_len = sizes.sparkSession.createDataFrame([(int(x), int(shares[x])) for x in range(steps + 1)], "_len int, _shares int")
    pieces = pieces.join(F.broadcast(by_len), "_len").withColumn("_share", F.pmod(F.xxhash64("_key", "piece_no"), F.col("_shares")).cast("int")).drop("_shares")
    table = np.zeros(int(shares.sum()), dtype=np.int64)
    for r in pieces.where("n > 0").groupBy("_len", "_share").count().collect() if shares.max() > 1 else []:
        table[first_share[r["_len"]] + r["_share"]] = r["count"]
    before = np.cumsum(table) - table
    offset = before - np.repeat(before[first_share], shares)
    lengths = np.flatnonzero(demand)
    plan = solve(lengths, demand[lengths], steps)
    # For each length, runs of ranks: (first rank, copies per container, first container).
    runs: dict[int, list[tuple[int, int, int]]] = {int(x): [] for x in lengths}
    at, container = {int(x): 0 for x in lengths}, 1
    for places, copies, times in plan:
        for x, k in zip(lengths[places].tolist(), copies.tolist(), strict=True):
            runs[x].append((at[x], k, container))
            at[x] += k * times
        container += times
    arrays = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["_len"].to_numpy()
            rank = offset[first_share[n] + b["_share"].to_numpy()] + b["_rank"].to_numpy() - 1
            where = np.zeros(len(b), dtype=np.int64)
            for x in np.unique(n[n > 0]):
                hit = n == x
                start, per, base = arrays[int(x)]
                k = np.searchsorted(start, rank[hit], side="right") - 1
                where[hit] = base[k] + (rank[hit] - start[k]) // per[k]
            yield b[["_key", "piece_no", "first", "n"]].assign(container=where)

    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_len", "_share").orderBy(F.xxhash64("_key", "piece_no"), "_key", "piece_no")))
    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"_key {kind}, piece_no int, first long, n int, container long").withColumnRenamed("_key", key)


def packing_gap(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, lower_bound, gap) of a packing: the bound is the dual solution that prices each unit at 1 / capacity,
    which no pattern exceeds; gap is the share of containers above it. An empty packing has none of either and no gap."""
    total = packed.where("n > 0").agg(F.coalesce(F.max("container"), F.lit(0)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    bound = F.ceil(F.col("_n") / capacity)
    return total.select("containers", bound.alias("lower_bound"), F.round(F.col("containers") / F.nullif(bound, F.lit(0)) - 1, 6).alias("gap"))
