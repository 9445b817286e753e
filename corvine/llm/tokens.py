"""Encoding of a corpus with a public tokenizer, by chunks that are shared across documents and encoded once."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import cut, salted_lookup, spread

#: Where the vocabulary files of public tokenizers lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A chunk ends where the rolling hash of the last WINDOW characters has CHUNK_BITS zero bits, so at 2^CHUNK_BITS characters on average.
WINDOW, CHUNK_BITS, LEAST_CHUNK, MOST_CHUNK = 16, 7, 16, 2048
#: Splits that end within so many characters of a chunk's end may look different in the whole text.
MARGIN = 4
#: Fixed value: a single blank between two other characters begins a split whatever stands around it.
_SURE = regex.compile(r"(?r)(?<=\S) (?=\S)")
_loaded: dict = {}


class Encoder:
    """The tokenizer of one worker, and the ids of single splits."""

    def __init__(self, folder: str) -> None:
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            got = self.bpe.encode_ordinary(piece)
            if len(self.known) < 200_000 and len(piece) < 40:
                self.known[piece] = got
        return got


def encoder(folder: str = TOKENIZERS) -> Encoder:
    if folder not in _loaded:
        _loaded[folder] = Encoder(folder)
    return _loaded[folder]


def chunks(text: str) -> list[str]:
    """Content-defined chunks: the same run of text is cut at the same places wherever it stands."""
    n = len(text)
    if n <= LEAST_CHUNK:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    gear = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    gear ^= gear >> np.uint64(29)
    rolling = gear.copy()
    for j in range(1, WINDOW):
        rolling[j:] += gear[:-j] << np.uint64(j)
    ends = np.flatnonzero(((rolling >> np.uint64(24)) & np.uint64((1 << CHUNK_BITS) - 1)) == 0) + 1
    out, at = [], 0
    for end in (*ends.tolist(), n):
        while end - at > MOST_CHUNK:
            out.append(text[at : at + MOST_CHUNK])
            at += MOST_CHUNK
        if end - at >= LEAST_CHUNK or end == n:
            if end > at:
                out.append(text[at:end])
            at = end
    return out


def encode_chunk(chunk: str, enc: Encoder) -> tuple[list[int], int, int]:
    """(ids, offset, ids before it): up to the offset the chunk's own splits hold in any text that begins with it."""
    ids = enc.bpe.encode_ordinary(chunk)
    sure, rest = 0, len(chunk) - MARGIN
    if rest > 0 and (m := _SURE.search(chunk, 0, rest)) is not None:
        sure = m.start()
    elif rest > 0:
        for m in enc.split.finditer(chunk):
            if m.end() > rest:
                break
            sure = m.end()
    return ids, sure, len(ids) - len(enc.bpe.encode_ordinary(chunk[sure:])) if sure else 0


def join_chunks(parts: list, enc: Encoder) -> list[int]:
    """The ids of the whole text from its chunks' (text, ids, offset, ids before it).

    The true position in the text is followed from split to split. Where it stands on a split of the next chunk's own
    encoding, that encoding holds from there to its sure offset and is taken over; between, at the chunk's joints, splits
    are encoded anew until both agree. As splitting looks only ahead, the result is exact.
    """
    text = "".join(p[0] for p in parts)
    out: list[int] = []
    at = start = 0
    for chunk, ids, sure, n_sure in parts:
        end = start + len(chunk)
        own, k = start, 0  # a split of the chunk's own encoding, and its ids so far
        while sure and at < end:
            while own < at and own < start + sure:
                m = enc.split.match(chunk, own - start)
                k += len(enc.ids(m.group()))
                own = start + m.end()
            if own == at and own <= start + sure:
                out.extend(ids[k:n_sure])
                at = start + sure
                break
            if at >= start + sure:
                break
            m = enc.split.match(text, at)
            out.extend(enc.ids(m.group()))
            at = m.end()
        start = end
        # What lies behind the sure offset waits for the next chunk.
        while at < end - MOST_CHUNK:
            m = enc.split.match(text, at)
            out.extend(enc.ids(m.group()))
            at = m.end()
    while at < len(text):
        m = enc.split.match(text, at)
        out.extend(enc.ids(m.group()))
        at = m.end()
    return out


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of every row's text by byte_bpe_50k, without special tokens.

    Null and empty texts give an empty list. A row comes out for each row that goes in, repeated keys included. The text
    of special tokens is plain text. Rows are numbered and cut into chunks once and kept in the shared folder, so that
    every later pass sees the same numbers. Chunks are made unique, by 128 bits of their SHA-256, before they are
    encoded; a chunk that stands in very many documents is salted when its ids (two bytes each) are joined back; a
    document is put together from its own chunks, with its text sent along once.
    """

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t) if t else [])

    @F.pandas_udf("ids binary, sure int, n_sure int")
    def encode(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(folder)
        rows = [encode_chunk(t, enc) for t in texts]
        return pd.DataFrame([(np.array(ids, dtype=np.uint16).tobytes(), sure, n) for ids, sure, n in rows], columns=["ids", "sure", "n_sure"])

    @F.pandas_udf("array<int>")
    def put_together(whole: pd.Series, parts: pd.Series) -> pd.Series:
        enc, out = encoder(folder), []
        for text, found in zip(whole, parts, strict=True):
            if not text:
                out.append([])
                continue
            own, at = [], 0
            for c in found:
                own.append((text[at : at + c["n"]], np.frombuffer(c["ids"], dtype=np.uint16).tolist(), c["sure"], c["n_sure"]))
                at += c["n"]
            out.append(join_chunks(own, enc))
        return pd.Series(out)

    rows = cut(spread(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).select(F.monotonically_increasing_id().alias("_row"), "_key", cut_up("_text").alias("_chunks")))
    placed = rows.select("_row", F.posexplode("_chunks").alias("_seq", "chunk")).withColumn("_hash", F.substring(F.unhex(F.sha2("chunk", 256)), 1, 16))
    known = placed.groupBy("_hash").agg(F.first("chunk").alias("chunk")).select("_hash", encode("chunk").alias("_e")).select("_hash", "_e.*")
    joined = salted_lookup(placed.select("_row", "_seq", "_hash", F.char_length("chunk").alias("n")), known, "_hash")
    parts = joined.select("_row", F.struct("_seq", "n", "ids", "sure", "n_sure").alias("_part"))
    none = [F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"), F.lit(None).cast("string").alias("_text")]
    both = parts.select("_row", *none, "_part").unionByName(rows.select("_row", "_key", F.array_join("_chunks", "").alias("_text"), F.lit(None).cast(parts.schema["_part"].dataType).alias("_part")))
    whole = both.groupBy("_row").agg(F.max("_key").alias("_key"), F.max("_text").alias("_text"), F.array_sort(F.collect_list("_part")).alias("_parts"))
    return whole.select(F.col("_key").alias(key), put_together("_text", "_parts").alias("ids"))
