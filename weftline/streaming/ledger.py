"""Streams over the append-only ledger and over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.sources.reports import ledger_schema


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the ledger as they are appended; rows without unit are left out."""
    return spark.readStream.schema(ledger_schema()).json(path).where("unit IS NOT NULL AND unit <> ''")


def changes_only(stream: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Entries that differ in ``values`` from the entry kept last for their key. State is one row per
    key. Within a batch entries go by ``order``; a late entry is compared with the latest kept one."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stream.schema]
    state = ", ".join(f"`{v}` string" for v in values)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get if held.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out = []
        for i, row in enumerate(rows[values].itertuples(index=False, name=None)):
            now = tuple(None if pd.isna(v) else str(v) for v in row)
            if last is None or now != tuple(last):
                out.append(i)
                last = now
        held.update(last)
        yield rows.iloc[out]

    return stream.groupBy(*keys).applyInPandasWithState(keep, ", ".join(fields), state, "append", GroupStateTimeout.NoTimeout)


def latest_by_key(stream: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """State in force per key, as a streaming aggregate (update mode)."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_m")).select(*keys, *(f"_m.{v}" for v in values))


def windowed_counts(events: DataFrame, at: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts per event-time window with a watermark. An extension of ours: the model has no event time."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def fan_out(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch to ``send``; at-least-once, batches are numbered."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_leases(leases: DataFrame, now) -> DataFrame:
    """Leases whose end is absent, unreadable or later than ``now``."""
    end = F.col("expires").cast("string").try_cast("timestamp_ntz")
    return leases.where(end.isNull() | (end > F.lit(now).cast("timestamp_ntz")))
