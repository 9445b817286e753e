"""Tables on disk: tables derived once and read again, keyed upserts, counters, and result sinks."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.common import shared_folder

#: To be raised when the form of derived tables changes; a change of the rules in the module that builds them shows by itself.
LAYOUT = 1


def _fs(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path, by Hadoop's interface, so that any shared storage will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _state(spark: SparkSession, path: str) -> list[tuple]:
    """Name, length and time of the files at a path; nothing where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]))


def replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a wholly written folder in the place of another one: the old one is moved aside before and deleted after, so that
    a crash leaves either of them whole."""
    fs, p = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(p):
        fs.rename(p, old)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), p):
        raise RuntimeError(f"{staged} can't be moved to {path}; the table before is {old}")
    fs.delete(old, True)


def replace_partitions(spark: SparkSession, staged: str, path: str) -> None:
    """Put the partitions of a wholly written table in the place of those of another, one by one, and leave its others."""
    fs, p = _fs(spark, staged)
    make = spark._jvm.org.apache.hadoop.fs.Path
    for x in fs.listStatus(p):
        name = x.getPath().getName()
        if x.isDirectory() and "=" in name:
            old = make(f"{path}.old-{uuid.uuid4().hex}-{name}")
            if fs.exists(make(path, name)):
                fs.rename(make(path, name), old)
            if not fs.rename(x.getPath(), make(path, name)):
                raise RuntimeError(f"{x.getPath()} can't be moved to {path}; the partition before is {old}")
            fs.delete(old, True)
    fs.delete(p, True)


def derived(spark: SparkSession, d: str, name: str, sources: list[str], build: Callable[[], DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """The table that ``build`` derives from tables of the directory ``d``, written once to the shared folder and read
    from there by every later query.

    It is partitioned by the columns ``by`` and sorted by ``order`` within them, so that look-ups prune folders by the
    former and row groups by the latter. Its place follows from the source files' names, lengths and times: new data
    make a new table. A table counts only when it is wholly written and moved to its place; of two sessions that write
    the same one, the later finds it there.
    """
    try:
        rules = inspect.getsource(inspect.getmodule(build))
    except (OSError, TypeError):  # the code comes without its source
        rules = ""
    state = [(t, _state(spark, f"{d}/{t}.parquet")) for t in sources]
    key = hashlib.sha256(repr((LAYOUT, rules, d, state)).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/derived/{key}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = build()
        staged = f"{path}.staged-{uuid.uuid4().hex}"
        out = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).write
        (out.partitionBy(*by) if by else out).parquet(staged)
        fs, p = _fs(spark, path)
        if not fs.exists(p) and not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), p) and not exists(spark, f"{path}/_SUCCESS"):
            raise RuntimeError(f"{staged} can't be moved to {path}")
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> dict[str, int]:
    """A table partitioned by namespace; a null namespace has a partition of its own. Returns the rows created."""
    df.write.mode("overwrite").partitionBy("namespace").parquet(path)
    return {"created": df.sparkSession.read.parquet(path).count(), "set": 0, "deleted": 0}


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> dict[str, int]:
    """Replace rows of equal key and add the others; returns the rows created and set.

    Only partitions of the namespaces that ``new`` touches are written again, to a new folder, and then take the place of
    the old ones one by one, so that a crash leaves each partition whole. Rows must be unique by key, of repeated ones any
    one stays.
    """
    fresh = new.dropDuplicates(key)
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])  # noqa: E731 - null keys are keys
    old, names = spark.read.parquet(path), fresh.select("namespace").distinct()
    touched = old.join(names, same(old, names, ["namespace"]), "left_semi")
    asked = fresh.select(*[F.col(c).alias(f"_{c}") for c in key])
    kept = touched.alias("o").join(asked, reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"_{c}")) for c in key]), "left_anti")
    n_set, n_fresh = touched.count() - kept.count(), fresh.count()
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    kept.unionByName(fresh, allowMissingColumns=True).write.partitionBy("namespace").parquet(staged)
    replace_partitions(spark, staged, path)
    return {"created": n_fresh - n_set, "set": n_set, "deleted": 0}


def delete_namespace(spark: SparkSession, path: str, namespace: str) -> dict[str, int]:
    """Drop a namespace by removing its partition; returns the rows deleted. No other row is read."""
    n = spark.read.parquet(path).where(F.col("namespace") == namespace).count()
    fs, p = _fs(spark, path)
    for x in fs.listStatus(p):
        name, _, value = x.getPath().getName().partition("=")
        if name == "namespace" and unquote(value) == namespace:
            fs.delete(x.getPath(), True)
    return {"created": 0, "set": 0, "deleted": n}


def scroll(table: DataFrame, key: str, after: object = None, size: int = 1) -> DataFrame:
    """The next ``size`` rows behind a key, in the key's order; from the beginning without one."""
    rows = table if after is None else table.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)
