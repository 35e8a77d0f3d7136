"""Grouped folds, ranked picks and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import ratio


def ranked(c: Column, order: Sequence[str]) -> Column:
    """The place of a value in an order given worst first; unknown values come last, null stays null."""
    out = F.lit(None).cast("int")
    for n, v in reversed(list(enumerate(order))):
        out = F.when(c == v, n).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(out, F.lit(len(order))))


def named(rank: Column, order: Sequence[str]) -> Column:
    """The value at a place of an order."""
    return F.element_at(F.array(*map(F.lit, order)), rank + 1)


def worst_of(df: DataFrame, keys: list[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value that comes first in ``order``; null values do not count."""
    return df.groupBy(*keys).agg(F.min(ranked(F.col(value), order)).alias("_r")).select(*keys, F.when(F.col("_r") < len(order), named(F.col("_r"), order)).alias(value))


def filled_counts(df: DataFrame, value: str, order: Sequence[str], by: list[str] | None = None) -> DataFrame:
    """Counts of every value of a fixed list, 0 where it does not occur. One aggregation, no join."""
    counts = df.groupBy(*(by or [])).agg(*(F.sum(F.when(F.col(value) == v, 1).otherwise(0)).alias(f"_{n}") for n, v in enumerate(order)))
    rows = F.array(*(F.struct(F.lit(v).alias(value), F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("long").alias("n")) for n, v in enumerate(order)))
    return counts.select(*(by or []), F.inline(rows))


def status_summary(df: DataFrame, keys: list[str], status: str, good: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key: rows, one count per status, and the share of good ones."""
    cols = [F.sum(F.when(F.col(status) == s, 1).otherwise(0)).cast("long").alias(s) for s in order]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *cols)
    return out.withColumn("rate", ratio(sum((F.col(s) for s in good), F.lit(0)), F.col("total")))


def three_valued(yes: Column, known: Column, empty: str = "unknown") -> Column:
    """Fold of a group: any known yes is `yes`; all known and none yes is `no`; else unknown."""
    return F.when(F.bool_or(F.coalesce(known, F.lit(False)) & F.coalesce(yes, F.lit(False))), "yes").when(F.bool_and(F.coalesce(known, F.lit(False))), "no").otherwise(empty)


def result_fold(failed: Column, passed: Column) -> Column:
    """Any failure fails; some known and all passed is demonstrated; else undecided."""
    no = F.lit(False)
    return F.when(F.bool_or(F.coalesce(failed, no)), "failing").when(F.bool_and(F.coalesce(passed, no)), "demonstrated").otherwise("undecided")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key, ties to the first by name; nulls do not count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m")).select(*keys, f"m.{value}", "m.n")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row per key in the given order (state after replaying all rows)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("m")).select(*keys, *(f"m.{v}" for v in values))


def changes_only(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows that differ in ``values`` from the row before them of the same key; nulls are equal to nulls."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.lag(F.struct(*values)).over(w)
    return df.withColumn("_p", prev).where(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.struct(*values))).drop("_p")


def replay(df: DataFrame, keys: list[str], order: list[str], op: str, name: str, new_name: str) -> DataFrame:
    """Objects in force after an ordered log of create, alter, rename and drop: ``keys, name``.

    Log rows of one key are folded in order; a rename moves the state to the new name. Keys
    are objects' scopes, so that a fold holds the statements on one scope only.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, F.col(op).alias("op"), F.col(name).alias("name"), F.col(new_name).alias("to"))))
    none = F.array().cast("array<string>")
    without = lambda s, n: F.filter(s, lambda x: x != n)
    step = lambda s, e: F.when(e["op"].isin("create", "replace"), F.array_union(s, F.array(e["name"]))).when(e["op"] == "drop", without(s, e["name"])).when((e["op"] == "rename") & F.array_contains(s, e["name"]), F.array_union(without(s, e["name"]), F.array(e["to"]))).otherwise(s)
    return df.groupBy(*keys).agg(log.alias("log")).select(*keys, F.explode(F.array_sort(F.aggregate("log", none, step))).alias("name"))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers per key: ``keys, first, last``; repeats count once, nulls not."""
    one = df.where(F.col(number).isNotNull()).select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    return one.withColumn("_g", F.col(number) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def compact_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The numbers of each key as text, `12-14, 20`."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    runs = islands(df, keys, number).select(*keys, F.struct("first", one.alias("t")).alias("r"))
    return runs.groupBy(*keys).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])).alias("ranges"))


def merged_hits(df: DataFrame, keys: list[str], hits: str) -> DataFrame:
    """Coverage of several reports as one: hits of equal lines are added; unknown lines stay unknown."""
    return df.groupBy(*keys).agg(F.sum(hits).alias(hits))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in a total order; ``k`` is the feature, not a guard."""
    return df.orderBy(*order).limit(k)


#: Groups in which the first of a key are found before they are brought together.
SPREAD = 32


def first_of(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """The first ``k`` distinct values of each key, sorted and joined by commas, and how many there are:
    ``keys, name, n, truncated``. Two levels, so a hot key is no single task and no large row."""
    one = df.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_g", F.pmod(F.xxhash64(value), F.lit(SPREAD)))
    near = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(value))
    few = one.withColumn("_r", near).groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("_r") <= k, F.col(value))).alias("v"))
    out = few.groupBy(*keys).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, k).alias("v"))
    return out.select(*keys, F.array_join("v", ",").alias(name), "n", F.greatest(F.col("n") - k, F.lit(0)).alias("truncated"))


def cochange(items: DataFrame, commit: str, item: str, most: int = 50, least_shared: int = 2, least_score: float = 0.25) -> DataFrame:
    """Pairs of items changed together: ``a, b, shared, score``, each shared commit adding 1 / items.

    Commits of more than ``most`` items say nothing and are left out; so a commit gives at most
    most * (most - 1) / 2 pairs.
    """
    one = items.where(F.col(commit).isNotNull() & F.col(item).isNotNull()).select(F.col(commit).alias("c"), F.col(item).alias("i")).distinct()
    sets = one.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= most) & (F.col("n") > 1))
    held = one.join(sets, "c").groupBy("c", "n").agg(F.sort_array(F.collect_list("i")).alias("l"))
    pairs = held.select("n", F.posexplode("l").alias("p", "a"), "l").select("n", "a", F.explode(F.expr("slice(l, p + 2, greatest(size(l) - p - 1, 0))")).alias("b"))
    score = F.sum(F.lit(1.0) / F.col("n"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), score.alias("score")).where((F.col("shared") >= least_shared) & (F.col("score") >= least_score - 1e-9))


def merged_edges(edges: DataFrame, ids: list[str], label: str) -> DataFrame:
    """Edges once, with their distinct labels; edges to themselves are left out. ``ids``: from, to, kind."""
    e = edges.where(F.col(ids[0]) != F.col(ids[1]))
    return e.groupBy(*ids).agg(F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(label, F.array().cast("array<string>"))))))).alias("labels"))
