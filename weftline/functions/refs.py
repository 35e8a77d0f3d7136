"""Grammar of reference strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope(ref: Column, owner: Column) -> Column:
    """The part before the last colon, if that stands behind the first sign; else the owner."""
    part = F.regexp_extract(ref, r"^(.+):[^:]*$", 1)
    return F.when(part == "", owner).otherwise(part)


def item(ref: Column) -> Column:
    """The part behind the last colon, if that stands behind the first sign; else all of it."""
    return F.when(ref.rlike(r"^.+:[^:]*$"), F.regexp_extract(ref, r"([^:]*)$", 1)).otherwise(ref)


def base(ref: Column) -> Column:
    """A reference without its case."""
    return F.regexp_replace(ref, r"#[^#]*$", "")


def case(ref: Column) -> Column:
    """The case of a reference; empty if it names none."""
    return F.regexp_extract(ref, r"#([^#]*)$", 1)


def case_label(inv: Column, case_id: Column) -> Column:
    """`INV-1` and `a` as `1a`; without a final number `inv#case`."""
    n = F.regexp_extract(inv, r"([0-9]+)$", 1)
    return F.when(n == "", F.concat(inv, F.lit("#"), case_id)).otherwise(F.concat(n, case_id))


def dotted_parent(name: Column) -> Column:
    """The parent of a dotted name; null at the top."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def top_group(name: Column) -> Column:
    """The first part of a dotted name."""
    return F.split(name, r"\.").getItem(0)
