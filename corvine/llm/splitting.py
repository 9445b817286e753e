"""Splitting oversized items at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import small
from corvine.llm.tokens import TOKENIZERS, encoder

#: Natural boundaries, the strongest first: ends of paragraphs, of statements and lines, of sentences, of words.
BOUNDARIES = [re.compile(r"\n[ \t\r]*\n+"), re.compile(r"\n"), re.compile(r"[.!?…。！？;:][\"'”’)\]]*(?:\s+|(?<=[。！？]))"), re.compile(r"\s+")]
#: A stronger boundary is taken if the piece is then at least so full; else a weaker one further right.
FILL = (0.5, 0.3, 0.3, 0.0)


def pieces(text: str, max_size: int, overlap: int, offsets: np.ndarray | None = None, measure: Callable[[int, int], int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces in characters, none above ``max_size``, each overlapping the one before.

    ``offsets`` are the prefix sums of sizes: the size of the text before each character (None: one per character).
    A cut is the last boundary under the limit, found by binary search in the sorted boundaries of the strongest kind
    that fills the piece well enough; without any, the piece is cut hard at the limit. The next piece begins ``overlap``
    before the cut, or at the cut where stepping back would not move on. A text within the limit is one piece.

    ``measure`` gives the true size of a piece where cutting changes it (a token cut in two may become more): a piece that
    comes out above the limit is cut again further left. Only a single character that alone exceeds the limit stays
    above it, as a piece of its own.
    """
    n = len(text)
    if max_size < 1:
        raise ValueError("max_size must be positive")
    overlap = max(0, min(overlap, max_size - 1))
    at = (lambda i: i) if offsets is None else (lambda i: int(offsets[i]))
    reach = (lambda size: min(n, size)) if offsets is None else (lambda size: int(np.searchsorted(offsets, size, side="right")) - 1)
    if at(n) <= max_size:
        return [(0, n)]
    marks = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]

    def cut_under(start: int, limit: int, allowed: int) -> int:
        for found, fill in zip(marks, FILL, strict=True):
            k = bisect_right(found, limit) - 1
            if k >= 0 and found[k] > start and at(found[k]) - at(start) >= max(fill * allowed, overlap + 1):
                return found[k]
        return limit

    out, start, done = [], 0, 0
    while True:
        allowed, most = max_size, n
        while True:
            limit = max(min(reach(at(start) + allowed), most), start + 1)
            end = n if limit >= n else cut_under(start, limit, allowed)
            over = measure(start, end) - max_size if measure else 0
            if over <= 0 or end == start + 1:
                break
            if allowed > 1:
                allowed = max(1, min(allowed, at(end) - at(start)) - over)
            else:  # within one token
                most = start + (end - start) // 2
        if end <= done:  # nothing new beside the overlap: without it
            start = done
            continue
        out.append((start, end))
        if end >= n:
            return out
        done = end
        back = reach(at(end) - overlap) if overlap else end
        if overlap and at(back) < at(end) - overlap:
            back += 1
        start = back if back > start else end


def token_offsets(text: str, folder: str = TOKENIZERS) -> np.ndarray:
    """Tokens that begin before each character of the text, by byte_bpe_50k."""
    enc = encoder(folder).bpe
    lengths = [len(b) for b in enc.decode_tokens_bytes(enc.encode_ordinary(text))]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if lengths else np.zeros(0, dtype=int)
    width = np.array([len(c.encode()) for c in text], dtype=np.int64) if text else np.zeros(0, dtype=int)
    ends = np.concatenate([[0], np.cumsum(width)])
    return np.searchsorted(starts, ends, side="left")


def _token_pieces(text: str, max_size: int, overlap: int, folder: str) -> list[tuple[int, int]]:
    """As pieces, in tokens; each piece is encoded by itself to learn its true size."""
    enc = encoder(folder).bpe
    return pieces(text, max_size, overlap, token_offsets(text, folder), lambda a, b: len(enc.encode_ordinary(text[a:b])))


def split_items(items: DataFrame, limits: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(item_table, item_key, piece_no, start, end, piece): the pieces of all items longer than their limit.

    ``items`` has item_table, item_key, item_kind (may be null) and content; ``limits`` is size_limit: the limit of an
    item is that of its table with its kind, trimmed and in small letters, else that of its table with a null kind; of
    repeated limits the smallest. No limit, a null content or one within the limit: no rows. Sizes are Unicode code points
    or tokens. Concatenating the pieces without their overlaps gives the content back; a character that alone exceeds the
    limit is a piece of its own. ``limits`` is broadcast if it is counted to be small; items in the limit never leave the
    JVM, each other item is cut where it is read.
    """
    limit = F.struct("max_size", "overlap_size", F.lower(F.trim("size_unit")).alias("size_unit"))
    by = limits.where("item_table is not null and max_size is not null").groupBy("item_table", F.lower(F.trim("item_kind")).alias("_kind")).agg(F.min(limit).alias("_limit"))
    own = small(by.where("_kind is not null").withColumnRenamed("_limit", "_own"))
    general = small(by.where("_kind is null").select("item_table", F.col("_limit").alias("_general")))
    kinded = items.select("item_table", "item_key", F.lower(F.trim("item_kind")).alias("_kind"), "content").where("content is not null")
    joined = kinded.join(own, ["item_table", "_kind"], "left").join(general, "item_table", "left").withColumn("_limit", F.coalesce("_own", "_general")).where("_limit is not null")
    joined = joined.select("item_table", "item_key", "content", "_limit.*")
    token = F.lower("size_unit") == "token"
    # A token is at least one byte, so a text of so many bytes can't have more tokens.
    long = joined.where(F.when(token, F.octet_length("content")).otherwise(F.char_length("content")) > F.col("max_size"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.unit == "token":
                    spans = _token_pieces(r.content, r.max_size, r.overlap_size, folder)
                else:
                    spans = pieces(r.content, r.max_size, r.overlap_size)
                if len(spans) > 1:
                    rows += [(r.item_table, r.item_key, k, a, z, r.content[a:z]) for k, (a, z) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["item_table", "item_key", "piece_no", "start", "end", "piece"])

    narrow = long.select("item_table", "item_key", "content", F.col("size_unit").alias("unit"), "max_size", "overlap_size")
    return narrow.mapInPandas(cut, "item_table string, item_key string, piece_no int, start int, end int, piece string")


def oversized_sources(context_items: DataFrame, units: DataFrame) -> DataFrame:
    """The items of both tables in one form. A unit that is loaded repeatedly counts once, with its longest code (the
    smallest among equals); its rows are reduced before the shuffle. Null ids are no items."""
    a = context_items.select(F.lit("context_item").alias("item_table"), F.col("item_id").cast("string").alias("item_key"), F.col("source_type").alias("item_kind"), "content")
    best = F.max(F.struct(F.char_length("code").alias("n"), F.col("code").alias("content")))
    b = units.where("id is not null and code is not null").groupBy("id").agg(best.alias("_u")).select(
        F.lit("code_unit").alias("item_table"), F.col("id").alias("item_key"), F.lit(None).cast("string").alias("item_kind"), F.col("_u.content").alias("content")
    )
    return a.unionByName(b)
