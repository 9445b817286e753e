"""Source files and documents as tables: scan, decode, language, and nested workflow documents."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension to language.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".cpp": "cpp", ".c": "c", ".rb": "ruby", ".php": "php",
}


def language_of(path: Column) -> Column:
    """The language of the extension in any case; null without one."""
    langs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return langs[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths."""
    return "^" + fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z") + "$"


def decode_bytes(b: bytes | None) -> str | None:
    """UTF-8, and Latin-1 where that fails; null stays null."""
    if b is None:
        return None
    try:
        return bytes(b).decode("utf-8")
    except UnicodeDecodeError:
        return bytes(b).decode("latin-1")


def decode(content: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(decode_bytes), "string")(content)


def scan(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(file_path, code, language, n_bytes, modified) of the files of a folder.

    Excluded are paths that hold an exclude text or match it as a glob, before any include glob is asked; a file that
    matches several includes comes once. Bytes of any kind are decoded, so no file fails a scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.col("path")
    for x in exclude or []:
        files = files.where(~(F.contains(path, F.lit(x)) | path.rlike(glob_pattern(x if x.startswith("*") else "*" + x))))
    if include:
        cond = F.lit(False)
        for x in include:
            cond = cond | path.rlike(glob_pattern(x if x.startswith("*") else "*/" + x))
        files = files.where(cond)
    return files.select(path.alias("file_path"), decode("content").alias("code"), language_of(path).alias("language"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def workflow(documents: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Phases and steps of nested workflow documents as (nodes, edges).

    A document is {title, phases: [{name, steps: [{id, name, time, depends_on, parallel_with}]}]}. Nodes: Document, Phase
    and Step; edges: HAS_PHASE, CONTAINS, DEPENDS_ON, PARALLEL_WITH both ways, and FOLLOWS from the step before in its
    phase to a step without dependencies. Times like "5 minutes" become minutes, others null; broken JSON gives no rows.
    """
    schema = "title string, phases array<struct<name string, steps array<struct<id string, name string, time string, depends_on array<string>, parallel_with array<string>>>>>"
    d = documents.select(F.from_json(column, schema).alias("d")).where("d.title is not null").select("d.*")
    ph = d.select("title", F.posexplode("phases").alias("phase_no", "p")).select("title", F.concat_ws("/", "title", "p.name").alias("phase_id"), F.col("p.name").alias("phase"), F.col("p.steps").alias("steps"))
    st = ph.select("title", "phase_id", F.posexplode("steps").alias("pos", "s")).select("title", "phase_id", "pos", "s.*").withColumn("step_id", F.concat_ws(":", "title", "id"))
    minutes, none = F.split_part("time", F.lit(" "), F.lit(1)).try_cast("double"), F.lit(None).cast("double")
    nodes = (
        d.select(F.col("title").alias("id"), F.lit("Document").alias("label"), F.col("title").alias("name"), none.alias("minutes"))
        .unionByName(ph.select(F.col("phase_id").alias("id"), F.lit("Phase").alias("label"), F.col("phase").alias("name"), none.alias("minutes")))
        .unionByName(st.select(F.col("step_id").alias("id"), F.lit("Step").alias("label"), "name", minutes.alias("minutes")))
    )
    link = lambda df, a, b, t: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"))
    other = lambda c: st.select("title", "step_id", F.explode(c).alias("o")).select("step_id", F.concat_ws(":", "title", "o").alias("o"))
    par = other("parallel_with")
    prev = st.select(F.col("phase_id"), (F.col("pos") + 1).alias("pos"), F.col("step_id").alias("before"))
    after = st.where("coalesce(size(depends_on), 0) <= 0").join(prev, ["phase_id", "pos"])
    edges = (
        link(ph, "title", "phase_id", "HAS_PHASE").unionByName(link(st, "phase_id", "step_id", "CONTAINS")).unionByName(link(other("depends_on"), "step_id", "o", "DEPENDS_ON"))
        .unionByName(link(par, "step_id", "o", "PARALLEL_WITH")).unionByName(link(par, "o", "step_id", "PARALLEL_WITH")).unionByName(link(after, "before", "step_id", "FOLLOWS"))
    )
    return nodes, edges.distinct()
