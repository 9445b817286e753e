"""Queries of the problems tagged llm."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.common import cut, table
from corvine.llm import credentials, docpairs, handwritten, langid, packing, splitting, syntax, tokens


def modules() -> list:
    return [sys.modules[__name__]]


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.oversized_sources(table(spark, d, "context_item"), table(spark, d, "code_unit"))
    return splitting.split_items(items, table(spark, d, "size_limit"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items above their limit: those that come out in pieces."""
    return _pieces(spark, d).where("piece_no = 0").select("item_table", "item_key")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their places."""
    return _pieces(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of source files on which a credential begins."""
    return credentials.credentials(table(spark, d, "source_file"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every source file with its credentials masked."""
    return credentials.redacted(table(spark, d, "source_file"))


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    """The places of all credentials in the bytes of their files."""
    return credentials.spans(table(spark, d, "source_file"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files not written by hand for their service."""
    return handwritten.not_handwritten(table(spark, d, "source_file")).select("file_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of such files per reason."""
    return handwritten.not_handwritten(table(spark, d, "source_file")).groupBy("reason").agg(F.count("*").alias("files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions with informative documentation."""
    return docpairs.documented_functions(table(spark, d, "source_file")).drop("documentation")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same with their documentation."""
    return docpairs.documented_functions(table(spark, d, "source_file"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files that don't parse."""
    return syntax.syntax_errors(table(spark, d, "source_file"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per repository and language."""
    return syntax.syntax_error_rates(table(spark, d, "source_file"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents"))


def _capacity(spark: SparkSession, d: str) -> int:
    return int(table(spark, d, "size_limit").where("item_table = 'documents' and lower(size_unit) = 'token'").agg(F.min("max_size")).first()[0])


def _containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.encode_corpus(table(spark, d, "documents")).select("doc_id", F.size("ids").alias("n_tokens")))
    return packing.pack(sizes, _capacity(spark, d))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, or pieces of those above the capacity, in containers."""
    return _containers(spark, d)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of containers by how full they are, in hundredths of the fullest."""
    fill = _containers(spark, d).where("n > 0").groupBy("container").agg(F.sum("n").alias("used"), F.count("*").alias("items"))
    return fill.groupBy(F.floor(F.col("used") / 100).alias("used_hundreds")).agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("items").alias("items"))


def p9_gap(spark: SparkSession, d: str) -> DataFrame:
    """Containers against the lower bound of the configuration program."""
    return packing.packing_gap(_containers(spark, d), _capacity(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or that mix languages."""
    return langid.wrong_labels(langid.language_passages(table(spark, d, "documents")))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with its language and confidence."""
    return langid.language_passages(table(spark, d, "documents")).drop("label_lang")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_redacted, p2_spans, p3_found, p3_reasons, p4_found, p4_pairs, p7_found, p7_rates, p8_ids, p9_containers, p9_report, p9_gap, p10_found, p10_passages)}
SQL = {
    "p1_found": """
        SELECT 'context_item' AS item_table, CAST(item_id AS VARCHAR) AS item_key FROM context_item c JOIN size_limit s ON s.item_table = 'context_item'
          AND lower(trim(c.source_type)) = lower(trim(s.item_kind)) WHERE length(content) > max_size
        UNION ALL SELECT DISTINCT 'code_unit', id FROM code_unit c JOIN size_limit s ON s.item_table = 'code_unit' AND s.item_kind IS NULL WHERE length(code) > max_size"""
}
