"""Queries of parsing, loading and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.common import table
from corvine.sources import files, parse
from corvine.streaming import ingest


def parsed_units(spark: SparkSession, d: str) -> DataFrame:
    """Every unit of every source file, by the parsers."""
    u = parse.units(table(spark, d, "source_file"))
    return u.select("id", "file_path", "namespace", "language", "name", "type", "line_start", "line_end", "parent", F.size("calls").alias("n_calls"), F.size("imports").alias("n_imports"), "complexity")


def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Units per language and type."""
    return parse.units(table(spark, d, "source_file")).groupBy("language", "type").agg(F.count("*").alias("units"))


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    """Files per language of their extension."""
    return table(spark, d, "source_file").groupBy(files.language_of(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with gaps of half an hour."""
    s = ingest.sessions(table(spark, d, "events"))
    return s.select("user_id", F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "events")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    w = ingest.windowed_counts(table(spark, d, "events"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (parsed_units, parsed_counts, file_languages, event_sessions, event_windows)}
SQL = {
    "file_languages": "SELECT language, count(*) AS files FROM (SELECT CASE lower(regexp_extract(file_path, '([.][^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.EXTENSIONS.items()) + " END AS language FROM source_file) GROUP BY 1",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM b GROUP BY user_id, s""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
