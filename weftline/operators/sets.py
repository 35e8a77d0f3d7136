"""Set operations, diffs and set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import canonical_hash


def union_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union that keeps, of equal keys, the row of the earliest part (ties by value)."""
    u = None
    for n, p in enumerate(parts):
        q = p.withColumn("_n", F.lit(n))
        u = q if u is None else u.unionByName(q)
    rest = [c for c in u.columns if c not in keys and c != "_n"]
    return u.groupBy(*keys).agg(F.min(F.struct("_n", *rest)).alias("m")).select(*keys, *(f"m.{c}" for c in rest))


def record_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, change``: added, removed or changed by the hash of the values; one row per key on each side.

    Both sides are hashed before the join, so wide records do not travel.
    """
    a = old.select(*keys, canonical_hash(*values).alias("ha"))
    b = new.select(*keys, canonical_hash(*values).alias("hb"))
    j = a.join(b, keys, "full_outer")
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed")
    return j.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def value_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Structural diff of flattened documents: ``keys, change, old, new`` per path."""
    a, b = old.select(*keys, F.col(value).alias("old")).distinct(), new.select(*keys, F.col(value).alias("new")).distinct()
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change", "old", "new")


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Links told from one side only: ``keys, side``."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(1)), right.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full_outer").where("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def similar_sets(members: DataFrame, owner: str, member: str, least: float = 0.8) -> DataFrame:
    """Classes of equal sets, and pairs of their representatives with Jaccard similarity of at
    least ``least``: ``a, b, shared, similarity`` (each pair once, ``a < b``).

    Owners with one and the same set are one class (see :func:`set_classes`), so copies are not
    expanded into pairs. Members are ordered by rarity; two sets can only be similar enough if
    they share one of their ``size - ceil(least * size) + 1`` rarest members, and if their sizes
    allow it. Pairs that pass are verified on the whole sets.
    """
    sets = set_classes(members, owner, member).where("owner = class").select("owner", "set")
    df = sets.select(F.explode("set").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    flat = sets.select("owner", F.size("set").alias("n"), F.explode("set").alias("m")).join(df, "m")
    place = F.row_number().over(Window.partitionBy("owner").orderBy("df", "m"))
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    prefix = flat.withColumn("p", place).where(F.col("p") <= keep).select("owner", "n", "m", "p")
    x, y = prefix.alias("x"), prefix.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) + 1
    need = F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    cand = x.join(y, F.col("x.m") == F.col("y.m")).where((F.col("x.owner") < F.col("y.owner")) & (F.col("x.n") >= least * F.col("y.n") - 1e-9) & (F.col("y.n") >= least * F.col("x.n") - 1e-9))
    # A shared member at places (p, q) leaves room for so many more: the positional bound. It holds for
    # the first shared member, whose rest is the largest, so a pair is lost by no later one.
    pairs = cand.groupBy(F.col("x.owner").alias("a"), F.col("y.owner").alias("b")).agg(F.max(rest - need).alias("slack")).where("slack >= 0").select("a", "b")
    full = pairs.join(sets.select(F.col("owner").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("owner").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    sim = shared / (F.size("sa") + F.size("sb") - shared)
    return full.select("a", "b", shared.cast("long").alias("shared"), sim.alias("s")).where(F.col("s") >= least - 1e-9).select("a", "b", "shared", (F.floor(F.col("s") * 10000 + 0.5) / 10000).alias("similarity"))


def set_classes(members: DataFrame, owner: str, member: str) -> DataFrame:
    """Each owner with its set and class, the first owner that has the same set. Null members
    are left out, owners without members have no class."""
    one = members.where(F.col(owner).isNotNull() & F.col(member).isNotNull()).select(F.col(owner).alias("owner"), F.col(member).alias("m")).distinct()
    sets = one.groupBy("owner").agg(F.sort_array(F.collect_list("m")).alias("set"))
    first = sets.groupBy("set").agg(F.min("owner").alias("class"))
    return sets.join(first, "set").select("owner", "set", "class")
