"""What changed between full snapshots (problem 3).

The rows of all snapshots are kept range-partitioned and sorted by key. Within a range
one stream runs over (key, snapshot); ``lag`` and ``lead`` are the two pointers of a merge
of each snapshot with the next, so every consecutive pair is merged in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import checked_broadcast, cut


def top_deliveries(df: DataFrame, snapshot: str, delivery: str) -> DataFrame:
    """The snapshots that are there, each with its highest delivery ``_top`` (no number is below all
    others). One row per snapshot; their number is checked before it is sent to all tasks."""
    top = F.max(F.coalesce(delivery, F.lit(-(2**31)))).alias("_top")
    return checked_broadcast(df.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(top))


def latest_rows(df: DataFrame, top: DataFrame, snapshot: str, key: str, values: list[str], delivery: str, loaded: str) -> DataFrame:
    """One row per key and snapshot: of the snapshot's highest delivery (``top``) the row loaded last.

    Rows without key or snapshot do not count. Ties in ``loaded`` take the greatest values,
    so repeated rows change nothing. Pre-aggregates before the shuffle: a key that holds a
    third of all rows shrinks to one row per map task.
    """
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull() & (F.col(key) != ""))
    rows = rows.join(top, snapshot).where(F.coalesce(delivery, F.lit(-(2**31))) == F.col("_top"))
    last = F.max(F.struct(F.col(loaded).alias("_loaded"), *values)).alias("_last")
    return rows.groupBy(key, snapshot).agg(last).select(key, snapshot, *(F.col(f"_last.{v}").alias(v) for v in values))


def present_snapshots(top: DataFrame, snapshot: str) -> DataFrame:
    """Each snapshot with its nearest lower and higher one. One row per snapshot, as of
    :func:`top_deliveries`; their number does not grow with the data, so one window task is enough."""
    w = Window.partitionBy(F.lit(0)).orderBy(snapshot)
    return top.where(F.col(snapshot).isNotNull()).select(snapshot).distinct().select(snapshot, F.lag(snapshot).over(w).alias("_prev"), F.lead(snapshot).over(w).alias("_next"))


def snapshot_changes(rows: DataFrame, present: DataFrame, snapshot: str, key: str, values: list[str]) -> DataFrame:
    """Typed changes ``(snapshot, key, change, old_*, new_*)`` between consecutive snapshots.

    ``rows`` has one row per key and snapshot. ``added``: not in the lower snapshot;
    ``removed``: not in the higher one (reported there); ``changed``: any of ``values``
    differs, where null equals null. The first snapshot has no changes. Empty input gives no rows.
    """
    ranged = rows.join(checked_broadcast(present), snapshot).repartitionByRange(key)
    w = Window.partitionBy(key).orderBy(snapshot)
    now = [F.col(v) for v in values]
    prev = [F.lag(v).over(w).alias(f"_old_{v}") for v in values]
    merged = ranged.select(key, snapshot, "_prev", "_next", *now, *prev, F.lag(snapshot).over(w).alias("_behind"), F.lead(snapshot).over(w).alias("_ahead"))
    none = [F.lit(None).cast(rows.schema[v].dataType) for v in values]
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"_old_{v}"))

    def event(at: Column, change: str, old: list[Column], new: list[Column]) -> Column:
        return F.struct(at.alias("at"), F.lit(change).alias("change"), *(o.alias(f"old_{v}") for o, v in zip(old, values)), *(n.alias(f"new_{v}") for n, v in zip(new, values)))

    old = [F.col(f"_old_{v}") for v in values]
    joined = F.col("_behind").eqNullSafe(F.col("_prev"))
    arrival = F.when(F.col("_prev").isNotNull() & ~joined, event(F.col(snapshot), "added", none, now)).when(F.col("_prev").isNotNull() & differs, event(F.col(snapshot), "changed", old, now))
    leaving = F.when(F.col("_next").isNotNull() & ~F.col("_ahead").eqNullSafe(F.col("_next")), event(F.col("_next"), "removed", now, none))
    out = merged.select(key, F.explode(F.array_compact(F.array(arrival, leaving))).alias("_e"))
    return out.select(F.col("_e.at").alias(snapshot), key, "_e.change", *(f"_e.old_{v}" for v in values), *(f"_e.new_{v}" for v in values))


def plain_key(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, r"[\s\p{Z}\x{200B}\x{FEFF}]+", ""))


def plain_value(c: Column) -> Column:
    """Without case and outer white space, with ``-``, space and ``_`` as equal; null is the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-\s\p{Z}]", "_"), F.lit(""))


def promise_changes(audit: DataFrame) -> DataFrame:
    """Changes of ``class`` and ``signals.demonstrated.value`` per promise, with old and new values."""
    rows = audit.select("snapshot_no", "delivery", "loaded_at", plain_key(F.col("promise")).alias("promise"), plain_value(F.col("class")).alias("class"), plain_value(F.col("signals.demonstrated.value")).alias("demonstrated"))
    top = top_deliveries(audit, "snapshot_no", "delivery")
    # Written once, so that finding the ranges reads the keys alone.
    last = cut(latest_rows(rows, top, "snapshot_no", "promise", ["class", "demonstrated"], "delivery", "loaded_at"))
    return snapshot_changes(last, present_snapshots(top, "snapshot_no"), "snapshot_no", "promise", ["class", "demonstrated"])
