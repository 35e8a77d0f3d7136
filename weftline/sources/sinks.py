"""Writers: canonical and sharded graphs, versioned swaps, keyed merges and append-if-changed logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sharded(df: DataFrame, path: str, group: str) -> None:
    """One shard per top-level group, sorted within; readers prune by group. Hot groups are
    spread over as many files as their rows need by a salt."""
    spread = df.withColumn("_s", F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(16)))
    spread.repartition(group, "_s").drop("_s").sortWithinPartitions(group).write.mode("overwrite").partitionBy(group).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows as a set with multiplicities, whatever their order: equal tables, equal hash."""
    one = F.xxhash64(*[F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})])
    two = F.xxhash64(F.lit(1), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    r = df.select(one.alias("a"), two.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return f"{r['n']}-{r['a']}-{r['b']}"


POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that a folder written by :func:`swap` holds; None if there is none yet."""
    jvm, at, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return spark.read.parquet(f"{path}/{name.strip()}")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write a table only if its content differs from what is there; True if written."""
    have = current(df.sparkSession, path)
    if have is not None and content_hash(have) == content_hash(df):
        return False
    swap(df, path)
    return True


def swap(df: DataFrame, path: str) -> None:
    """Replace a table: a version of its own beside the others, then the pointer to it in one step, so
    that :func:`current` gives the old or the new one at any moment. The version before stays for
    those who still read it; older ones go."""
    spark = df.sparkSession
    jvm, root, fs = _fs(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    was = current(spark, path)
    kept = {name, POINTER, *(f.split("/")[-2] for f in (was.inputFiles() if was is not None else []))}
    df.write.parquet(f"{path}/{name}")
    conf = spark._jsc.hadoopConfiguration()
    note, at = jvm.org.apache.hadoop.fs.Path(f"{path}/_{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    out = fs.create(note, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(note), fs.makeQualified(at), options)
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() not in kept:
            fs.delete(f.getPath(), True)


class StaleVersion(ValueError):
    """A put that expected another version than the one in force."""


def put(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Merge versioned records: new keys need version 1, known ones the version in force plus one.

    If any row is stale nothing is written and StaleVersion is raised. One writer at a time.
    """
    have = current(spark, path)
    if have is None:
        have = rows.where("1 = 0")
    now = have.select(*keys, F.col(version).alias("_have"))
    stale = rows.join(now, keys, "left").where(F.col(version) != F.coalesce(F.col("_have"), F.lit(0)) + 1)
    if not stale.isEmpty():
        raise StaleVersion(f"stale rows for {path}")
    merged = have.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
    swap(merged, path)
    return current(spark, path)


def append_changed(log: DataFrame, entries: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Those of the new entries that differ from the entry before them of the same key, old or new."""
    both = log.withColumn("_new", F.lit(False)).unionByName(entries.withColumn("_new", F.lit(True)))
    w = Window.partitionBy(*keys).orderBy("_new", *order)
    p = F.lag(F.struct(*values)).over(w)
    return both.withColumn("_p", p).where(F.col("_new") & (F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.struct(*values)))).drop("_p", "_new")
