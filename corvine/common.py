"""Session, checkpoint and skew helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than total / (HOT_SHARE * partitions) rows counts as hot; so there are at most HOT_SHARE * partitions hot keys.
HOT_SHARE = 4
#: Keys with fewer rows than this are never worth salting.
HOT_LEAST = 20_000
#: A list of one node's neighbours holds at most about so many; longer ones come in parts.
PART_ROWS = 20_000
#: Lists of keys up to this many rows are broadcast.
SMALL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvine")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Without one a session in one process (tests) gets a local folder;
    on a cluster that is an error, as executors don't see each other's disks."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not conf and not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that later queries read again: spark.checkpoint.dir, or the session's own folder in tests."""
    ensure_checkpoint_dir(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return conf or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table in few files over the session's cores, before work that costs far more than a shuffle.

    A table that already comes in as many partitions as there are cores (any large one) is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint if a count finds it to have at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def norm_id(col: Column | str) -> Column:
    """Ids and types are the same when equal after trimming and lower-casing; a null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def iso_ts(col: Column | str) -> Column:
    """ISO text to timestamp: with or without fraction, ``T`` or blank, ``Z``, an offset or nothing (then UTC).

    Null, empty and malformed texts give null; the session's time zone has no influence.
    """
    c = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\r\n"))
    zoned = F.when(c.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$") & (F.length(c) > 10), c).otherwise(F.concat(c, F.when(F.length(c) == 10, "T00:00:00Z").otherwise("Z")))
    return F.when(F.length(c) >= 10, zoned.try_cast("timestamp"))


def hot_keys(df: DataFrame, key: str, least: int = HOT_LEAST) -> DataFrame:
    """(key, n_salts) of the keys that hold more than their share of the rows, at most HOT_SHARE * shuffle partitions of them,
    with so many pieces that none holds more than that share."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    share = F.greatest(F.lit(least), counts.agg(F.sum("_n")).scalar() / (HOT_SHARE * parts))
    return counts.where(F.col("_n") > share).select(key, F.greatest(F.lit(2), F.ceil(F.col("_n") / share)).cast("int").alias("n_salts"))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Sort-merge join of ``left`` with the key-unique ``right`` where the rows of a hot key are spread over many tasks.

    Rows of a hot key on the left get a salt by the hash of their other columns, the same whenever a task is run again;
    the one row of that key on the right is copied once per salt. All other keys keep salt 0, so nothing but the bounded
    list of hot keys is copied or broadcast.
    """
    hot = (hot if hot is not None else hot_keys(left, key)).select(F.col(key).alias("_hot"), F.col("n_salts").alias("_salts"))
    rest = [f.name for f in left.schema.fields if f.name != key and "map" not in f.dataType.simpleString()] or [key]
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rest), F.col("_salts")).cast("int"))
    ).drop("_hot", "_salts")
    copies = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_salts") - 1)))
    ).drop("_hot", "_salts")
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def part_of_hot(df: DataFrame, key: str, member: str) -> DataFrame:
    """Add ``part``: 0, and for a key with more than PART_ROWS rows one of as many parts as keep to that number, by the MD5 of
    ``member``; so a group by key and part can be collected, and the parts depend on nothing but the rows. Keys that long
    are broadcast while they are few (SMALL_ROWS, counted) and joined otherwise."""
    long = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > PART_ROWS).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / PART_ROWS).alias("_parts"))
    long = cut(long)
    long = small(long)
    part = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.conv(F.substring(F.md5(member), 1, 8), 16, 10).cast("long"), F.col("_parts")).cast("int"))
    return df.join(long, F.col(key) == F.col("_hot"), "left").withColumn("part", part).drop("_hot", "_parts")


def numbered(df: DataFrame, key: str, order: list[Column], name: str = "place") -> DataFrame:
    """Number the rows of each key in a total order, without gathering a hot key in one task.

    Rows are range-partitioned by key and order, numbered within (key, partition), and shifted by the sizes of the key's
    earlier partitions. The partitioned rows are checkpointed, so that both passes see the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, F.col(key), *order).withColumn("_at", F.spark_partition_id()))
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_at").orderBy(*order)))
    sizes = placed.groupBy(key, "_at").agg(F.count("*").alias("_size"))
    shift = sizes.select(key, "_at", (F.sum("_size").over(Window.partitionBy(key).orderBy("_at")) - F.col("_size")).alias("_shift"))
    return local.join(shift, [key, "_at"]).withColumn(name, F.col("_n") + F.col("_shift")).drop("_at", "_n", "_shift")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
