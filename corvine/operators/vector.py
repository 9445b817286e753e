"""Exact vector search: cosine by expression for one query, blocks of matrix products for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.model import point_id

#: Rows of one block of the batch search; blocks are made by a hash, so their number follows the table. Rows are sent as often
#: as there are blocks of queries, and the other way round, so large blocks move less; scores are made for so many queries
#: at a time.
BLOCK_ROWS, QUERIES_AT_ONCE = 16_384, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, label, score) of all rows that have a cosine with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", "label", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null")


def search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(vec_id, score) of the best k among the rows that pass the filter, scores rounded before ranking."""
    rows = scored(vectors if where is None else vectors.where(where), query)
    rows = rows if threshold is None else rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "vec_id").limit(k)


def fanout(vectors: DataFrame, query: list[float], per_group: int, k: int) -> DataFrame:
    """V5, V7: the best few of each group, merged to the best k; a group's rows are pruned before they are ranked."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", "label", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).drop("_r").orderBy(F.desc("score"), "vec_id").limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest of each query among all rows but itself, exact.

    Rows and queries are dealt by hash into blocks of bounded size; each block of queries is sent once to each block of
    rows, a task holds one pair of blocks, multiplies them and keeps k rows per query. Vectors of no length or null are
    left out; ties go to the smaller id.
    """
    v = vectors.where("embedding is not null and size(embedding) > 0")
    q = queries.where("embedding is not null and size(embedding) > 0")
    nv, nq = max(1, -(-v.count() // BLOCK_ROWS)), max(1, -(-q.count() // BLOCK_ROWS))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = v.select("vec_id", "embedding", block(nv).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asks = q.select("vec_id", "embedding", block(nq).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        unit = lambda x: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.array(x.to_list(), dtype=np.float64))
        rows, asked, ids, mine, out = unit(a["embedding"]), unit(b["embedding"]), a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), []
        for at in range(0, len(asked), QUERIES_AT_ONCE):
            s = np.round(asked[at : at + QUERIES_AT_ONCE] @ rows.T, 6)
            for i, me in enumerate(mine[at : at + QUERIES_AT_ONCE]):
                some = np.flatnonzero(s[i] >= np.partition(s[i], -k - 1)[-k - 1]) if len(ids) > k + 1 else np.arange(len(ids))
                order = some[np.lexsort((ids[some], -s[i][some]))]
                order = order[ids[order] != me][:k]
                out.append(pd.DataFrame({"query_id": me, "vec_id": ids[order], "score": s[i][order]}))
        return pd.concat(out)

    near = rows.groupBy("vb", "qb").cogroup(asks.groupBy("vb", "qb")).applyInPandas(multiply, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """V4: a deterministic embedding offline: the 32 bytes of SHA-256 in turn, scaled to -1..1."""
    digest = F.sha2(text, 256)
    at = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: at(i) / 255 * 2 - 1)


def embed(texts: DataFrame, column: str, embedder=None) -> DataFrame:
    """V2, V3: adds ``embedding``; an embedder is a function from a list of texts to a list of vectors, run per Arrow
    batch; without one the hash embedding is used."""
    if embedder is None:
        return texts.withColumn("embedding", hash_embedding(F.coalesce(F.col(column), F.lit(""))))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embedder(b.fillna("").to_list()))

    return texts.withColumn("embedding", run(column))


def unit_text() -> Column:
    """What is embedded of a unit: signature, docstring and the first 500 characters, absent parts left out."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", part(F.col("signature")), part(F.col("docstring")), part(F.substring("code", 1, 500)))


def chunk_points(chunks: DataFrame, docs: DataFrame, embedder=None) -> DataFrame:
    """A point for each chunk (doc_id, chunk_index, total_chunks, content): its id, embedding and payload, the chunk's own
    places and the title, source and namespace of its document."""
    x = chunks.join(docs.select("doc_id", "title", "source", "namespace"), "doc_id")
    x = embed(x, "content", embedder).withColumn("point_id", point_id(F.concat_ws("_", "doc_id", "chunk_index")))
    return x.select("point_id", "embedding", F.struct("doc_id", "chunk_index", "total_chunks", "title", "source", "namespace", "content").alias("payload"))


def relevance(score: str = "score") -> Column:
    """V6: high above one half."""
    return F.when(F.col(score) > 0.5, "high").otherwise("medium")
