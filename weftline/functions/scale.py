"""Helpers that keep plans safe at any size: lineage cuts, checked broadcasts, hot-key salting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be sent to every executor.
SMALL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the bundled tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where no such folder is set and all runs on one machine, as in local tests, a temporary one is.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(-cluster)?(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, old: DataFrame | None = None, **seen: Column) -> DataFrame:
    """Cut the lineage by a table written in the shared folder, and read it back.

    A lost executor then costs a task's work at most. The table carries a merge hint: the size
    of compressed files proves nothing about rows in memory, so the planner must not broadcast
    it unasked. ``old``: an earlier cut that nothing needs once this one is written; its files go.
    ``seen``: aggregates over the rows, taken while they are written; :func:`seen` tells them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    # The tasks that write count, each of them once, so a repeated stage counts no row twice.
    watch = Observation() if seen else None
    (df.observe(watch, *(c.alias(n) for n, c in seen.items())) if seen else df).write.parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._weftline_path = path
    out._weftline_seen = watch.get if watch else {}
    if old is not None:
        drop(old)
    return out


#: Tables written by :func:`cut` that are still there.
_WRITTEN: set[str] = set()


def seen(df: DataFrame, name: str):
    """An aggregate that :func:`cut` took of the table it wrote; 0 if there were no rows."""
    return df._weftline_seen.get(name) or 0


def drop(df: DataFrame) -> None:
    """Delete the files of a :func:`cut` table that is not needed any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def sweep(spark: SparkSession) -> int:
    """Delete all that :func:`cut` has written in this process and not dropped; how many tables. For
    callers who have written their results: a result that is still to be computed reads them."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def small_or_none(df: DataFrame, most: int = SMALL_ROWS) -> list | None:
    """The rows if there are at most ``most``, else None; never reads more than ``most + 1``."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def checked_broadcast(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else ``df`` as it is (a shuffled join)."""
    rows = small_or_none(df, most)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def hot_keys(df: DataFrame, keys: list[str], parts: int, least: int = 50_000, name: str = "_fan") -> DataFrame:
    """Keys that hold more than one ``parts``-th of the rows (and over ``least``), with a fan-out.

    At most ``parts`` keys can exceed that share, so the result is small by construction.
    """
    counts, n = df.groupBy(*keys).count(), df.count()
    limit = max(least, n // max(1, parts))
    return counts.where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias(name))


def salted(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], least: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: rows of hot keys of ``big`` are spread over several
    salts by a hash of ``spread``; the rows of ``small`` with such a key are repeated once for each."""
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hot_keys(big, keys, parts, least).collect()  # at most ``parts`` rows
    if not rows:
        return big.withColumn("_salt", F.lit(0)), small.withColumn("_salt", F.lit(0))
    fan = F.broadcast(big.sparkSession.createDataFrame(rows))
    b = big.join(fan, keys, "left").withColumn("_salt", F.when(F.col("_fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_fan")).cast("int"))).drop("_fan")
    s = small.join(fan, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    return b, s
