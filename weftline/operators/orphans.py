"""References to records that do not exist (problem 4).

A key is a stem and an integer (``payments.ledger:INV-`` and 12; a key that ends in no number has
-1). The sorted integers of a stem's parents are compressed into contiguous runs. A reference is
matched as-of to the run that starts last at or before its integer: it is an orphan, of no record
at all, if its integer lies beyond the run's end. In the same way the lives of each record, integers
of microseconds, are compressed into runs, and a reference to a record that is there is matched
as-of to the life that starts last at or before the moment it was recorded. Both runs stop at
buckets of the integers, so that a stem of a third of all rows is spread; keys referred to very
often are salted: references spread, the few runs repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import salted

#: End of a life that has not ended.
FOREVER = "TIMESTAMP_NTZ '9999-12-31 00:00:00'"


#: Integers of a stem that are held together.
BUCKET = 512
#: A key of a stem and an integer without leading zeros of at most 18 digits.
SPLIT = r"^(?s)(.*?)(0|[1-9][0-9]{0,17})$"


def split_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a key's ``_stem``, integer ``_n`` and bucket ``_b``; different keys differ in them."""
    stem, digits = F.regexp_extract(key, SPLIT, 1), F.regexp_extract(key, SPLIT, 2)
    n = F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1).cast("long"))
    return df.withColumns({"_stem": F.when(digits != "", stem).otherwise(F.col(key)), "_n": n}).withColumn("_b", F.floor(F.col("_n") / BUCKET))


def key_runs(parents: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct integers of each of ``keys`` and bucket as contiguous runs ``keys, _b, _n, _last``
    from ``_n`` to ``_last``. ``parents``: ``keys``, ``_b`` and ``_n``. No bucket holds more than ``BUCKET``."""
    each = parents.select(*keys, "_b", "_n").distinct()
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_n"))
    return each.withColumn("_run", island).groupBy(*keys, "_b", "_run").agg(F.min("_n").alias("_n"), F.max("_n").alias("_last")).drop("_run")


def life_runs(parents: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Lives per key compressed into contiguous runs ``keys, _from, _to``; a null end is open.

    Repeated rows are dropped before the shuffle. A row without start keeps its key known
    (``_from`` null) but holds at no moment.
    """
    lives = parents.select(*keys, F.col(start).cast("timestamp_ntz").alias("_from"), F.coalesce(F.col(end).cast("timestamp_ntz"), F.expr(FOREVER)).alias("_to")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("_from").asc_nulls_first(), "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("_from").isNull() | before.isNull() | (F.col("_from") > before)).cast("int")
    numbered = lives.withColumn("_open", opens).withColumn("_run", F.sum("_open").over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_run")


def orphans(refs: DataFrame, parents: DataFrame, keys: list[str], key: str, at: str, row: list[str], start: str, end: str) -> DataFrame:
    """The references of ``refs`` that did not hold at ``at``, with ``state`` missing, late or deleted.

    ``refs``: ``keys``, ``key``, ``at`` and ``row`` (columns that tell the rows apart; also used to
    spread hot keys). ``parents``: ``keys``, ``key`` and the moments ``start`` and ``end`` of a life.
    A reference without moment (``at`` null) holds nowhere: it is ``missing`` if the key is unknown,
    else ``deleted``. Null keys refer to nothing and are no parents.
    """
    known = split_key(parents.where(F.col(key).isNotNull()).select(*keys, key, start, end), key)
    known = known.select(*keys, "_stem", "_b", "_n", start, end).distinct().repartition(*keys, "_stem", "_b")
    group = [*keys, "_stem"]
    runs = key_runs(known, group).select(*group, "_b", "_n", F.lit(None).cast("timestamp_ntz").alias("_at"), F.lit(None).cast("timestamp_ntz").alias("_to"), "_last", F.lit(0).alias("_side"))
    lives = life_runs(known, [*group, "_b", "_n"], start, end).select(*group, "_b", "_n", F.col("_from").alias("_at"), "_to", F.lit(None).cast("long").alias("_last"), F.lit(1).alias("_side"))
    refs = split_key(refs.where(F.col(key).isNotNull()).select(*keys, key, F.col(at).cast("timestamp_ntz").alias("_at"), *row), key)
    refs, held = salted(refs, runs.unionByName(lives), [*group, "_b"], [*row, "_at"])
    empty = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in [*row, key]]
    both = held.select(*group, "_b", "_salt", "_n", "_at", "_to", "_last", "_side", *empty).unionByName(
        refs.select(*group, "_b", "_salt", "_n", "_at", F.lit(None).cast("timestamp_ntz").alias("_to"), F.lit(None).cast("long").alias("_last"), F.lit(2).alias("_side"), *row, key)
    )
    # One order serves both: by integer, then by moment; a run of keys has no moment and comes first.
    time = [F.col("_at").asc_nulls_first(), F.col("_side")]
    of_key = Window.partitionBy(*group, "_b", "_salt").orderBy("_n", *time).rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy(*group, "_b", "_salt", "_n")
    of_life = part.orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    matched = both.select(
        *keys, key, "_n", "_at", "_side", *row,
        F.last("_last", ignorenulls=True).over(of_key).alias("_last"),
        F.last(F.when(F.col("_at").isNotNull(), F.col("_to")), ignorenulls=True).over(of_life).alias("_end"),
        F.max(F.when(F.col("_side") == 1, F.col("_at"))).over(part).alias("_latest"),
    )
    there = F.coalesce(F.col("_n") <= F.col("_last"), F.lit(False))
    holds = there & F.coalesce(F.col("_at") < F.col("_end"), F.lit(False))
    state = F.when(~there, "missing").when(F.col("_latest") > F.col("_at"), "late").otherwise("deleted")
    return matched.where((F.col("_side") == 2) & ~holds).select(*row, *keys, key, F.col("_at").alias(at), state.alias("state"))


def trimmed(name: str) -> Column:
    """A column without outer white space of any kind."""
    return F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def plain_ref(c: Column) -> Column:
    """A reference without outer white space, case suffix (from ``#`` on) and final ``()``."""
    c = F.regexp_replace(c, r"#(?s:.*)$", "")
    c = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\(\)$", ""), r"[\s\p{Z}]+$", "")


def rtm_references(rtm: DataFrame) -> DataFrame:
    """Every reference of the matrix, one row each: ``row_id, field, target, ref_key, recorded_at``.

    Null or empty lists, elements and references give none; repeated rows give one.
    """
    feature = F.coalesce(trimmed("feature_id"), F.lit(""))

    def invariant(c: Column) -> Column:
        return F.when(c.rlike("^[^:]+:"), c).otherwise(F.concat(feature, F.lit(":"), F.regexp_replace(c, "^:", "")))

    def listed(c: Column, field: str, target: str) -> Column:
        parts = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), plain_ref), lambda x: x.isNotNull() & (x != ""))
        if field == "maps_to":
            parts = F.transform(parts, invariant)
        if field == "invariant_id":
            parts = F.transform(parts, lambda x: F.concat(feature, F.lit(":"), x))
        return F.transform(parts, lambda x: F.struct(F.lit(field).alias("field"), F.lit(target).alias("target"), x.alias("ref_key")))

    every = F.concat(
        listed(F.split("maps_to", ","), "maps_to", "invariant"), listed(F.array("invariant_id"), "invariant_id", "invariant"),
        listed(F.col("enforcers"), "enforcers", "code"), listed(F.col("verifiers"), "verifiers", "test"),
    )
    out = rtm.select("row_id", "recorded_at", F.explode(F.array_distinct(every)).alias("_r"))
    return out.select("row_id", F.col("_r.field").alias("field"), F.col("_r.target").alias("target"), F.col("_r.ref_key").alias("ref_key"), "recorded_at")


def rtm_targets(invariants: DataFrame, symbols: DataFrame) -> DataFrame:
    """All parent rows as ``target, ref_key, created_at, deleted_at``; a null ``is_test`` is no test."""
    inv = invariants.select(F.lit("invariant").alias("target"), F.concat_ws(":", trimmed("feature"), trimmed("inv")).alias("ref_key"), "created_at", "deleted_at")
    sym = symbols.select(F.when(F.coalesce("is_test", F.lit(False)), "test").otherwise("code").alias("target"), trimmed("fqn").alias("ref_key"), "created_at", "deleted_at")
    return inv.unionByName(sym).where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


def rtm_orphans(rtm: DataFrame, invariants: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of the matrix that did not hold when recorded: ``row_id, field, ref_key, state, in_month``."""
    found = orphans(rtm_references(rtm), rtm_targets(invariants, symbols), ["target"], "ref_key", "recorded_at", ["row_id", "field"], "created_at", "deleted_at")
    month = F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit(""))
    return found.select("row_id", "field", "ref_key", "state", month.alias("in_month")).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per field, month and state."""
    return found.groupBy("field", "in_month", "state").agg(F.count(F.lit(1)).alias("orphans"))
