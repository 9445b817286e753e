"""Chunking and text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections longer than this are cut at their own headings; the name of what stands before the first.
LONG_SECTION, FIRST_PART = 3000, "main"
_STRIP = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Pieces between separators, stripped, empty ones left out; a null text gives null."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def greedy_chunks(parts: Column, max_chars: int, overlap: int = 0, separator: str = "\n\n") -> Column:
    """Pack paragraphs in order. A chunk is closed before a paragraph that would take its characters above the
    limit (separators aren't counted); a longer paragraph stays whole; the next chunk opens with the last ``overlap``
    characters of the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p)
        full = (acc["size"] + n > max_chars) & (F.size(acc["cur"]) > 0)
        joined = F.array_join(acc["cur"], separator)
        lap = F.right(joined, F.lit(overlap)) if overlap else None
        fresh = F.array(lap, p) if overlap else F.array(p)
        fresh_size = (F.length(lap) if overlap else F.lit(0)) + n
        return F.when(full, F.struct(F.array_append(acc["done"], joined).alias("done"), fresh.alias("cur"), fresh_size.cast("int").alias("size"))).otherwise(
            F.struct(acc["done"].alias("done"), F.array_append(acc["cur"], p).alias("cur"), (acc["size"] + n).cast("int").alias("size"))
        )

    return F.aggregate(parts, empty, add, lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["done"], F.array_join(a["cur"], separator))).otherwise(a["done"]))


def chunk_rows(docs: DataFrame, key: str, text: str, max_chars: int, overlap: int = 0) -> DataFrame:
    """C4: (key, chunk_index, total_chunks, word_count, char_count, content)."""
    x = docs.select(key, greedy_chunks(paragraphs(F.col(text)), max_chars, overlap).alias("c"))
    x = x.select(key, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "content"))
    words = F.size(F.filter(F.split(strip(F.col("content")), r"\s+"), lambda w: w != ""))
    return x.select(key, "chunk_index", "total_chunks", words.alias("word_count"), F.length("content").alias("char_count"), "content")


def title(text: Column) -> Column:
    """The first of the first three lines that begins with #, without the signs; else null."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), strip)
    return strip(F.regexp_replace(F.try_element_at(F.filter(lines, lambda x: x.startswith("#")), F.lit(1)), "^#+", ""))


def sections(docs: DataFrame, key: str, text: str, mark: str = "## ", first: str = "Overview") -> DataFrame:
    """(key, section_no, heading, body): pieces between headings; the part before the first has a name of its own,
    a later part without a line end is left out."""
    x = docs.select(key, F.posexplode(F.split(F.col(text), "\n" + mark)).alias("section_no", "part"))
    cut = F.locate("\n", F.col("part"))
    head = F.when(F.col("section_no") == 0, F.lit(first)).otherwise(F.substr(F.col("part"), F.lit(1), cut - 1))
    body = F.when(F.col("section_no") == 0, F.col("part")).otherwise(F.substr(F.col("part"), cut + 1))
    return x.where("section_no = 0 or part like '%\n%'").select(key, "section_no", strip(head).alias("heading"), strip(body).alias("body"))


def line_counts(code: Column) -> tuple[Column, Column]:
    """Lines, and lines that are neither blank nor begin like a comment."""
    lines = F.split(code, "\n")
    isnt = lambda x: (strip(x) != "") & ~strip(x).rlike(r"^(?:#|//|/\*|\*)")
    return F.size(lines), F.size(F.filter(lines, isnt))


def wrap(text: Column, width: int = 76) -> Column:
    """Words filled into lines of at most ``width`` characters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def add(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.concat(last, F.lit(" "), w))).otherwise(F.array_append(acc, w))

    return F.aggregate(words, F.array().cast("array<string>"), add)


def subsections(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, section_no, heading, body) above LONG_SECTION characters in parts at lines that open with ### ,
    the first one named main; shorter ones stay one part without a name."""
    long = F.char_length("body") > LONG_SECTION
    parts = F.when(long, F.split("body", r"\n### ")).otherwise(F.array("body"))
    x = sections.select("doc_id", "section_no", "heading", long.alias("_long"), F.posexplode(parts).alias("part_no", "_p"))
    titled = F.col("_long") & (F.col("part_no") > 0)
    name = F.when(titled, strip(F.substring_index("_p", "\n", 1))).when(F.col("_long"), FIRST_PART)
    body = F.when(titled, F.when(F.contains("_p", F.lit("\n")), F.substring("_p", F.instr("_p", "\n") + 1, F.length("_p"))).otherwise("")).otherwise(F.col("_p"))
    return x.select("doc_id", "section_no", "heading", "part_no", name.alias("part"), strip(body).alias("body"))
