"""Structural diff of manifests, version by version (D3).

Bodies are brought to one form, as differently written but equal ones must not differ: plain
field names, lists of records in one shape, empty values absent. Each version is compared with
the one before, field by field; lists whose items all carry a name on both sides are compared
item by item (``invariants[INV-1].statement``), other lists as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import deep
from weftline.functions.scale import cut
from weftline.operators.nested import BARE, LIST, OBJECT, RECORD_LISTS, plain_name, records

#: Frames allowed for very deep values.
DEEPEST = 50_000

#: Fields that name an item of a list; the first one that every item of both sides carries, with distinct values, is used.
LIST_KEYS = ("id", "code", "adr", "seat", "feature", "symbol")
PAIR = ["feature_id", "from_version", "version", "from_manifest", "manifest_id"]


class Pairs(list):
    """The fields of a JSON object in written order."""


class Trees:
    """A JSON value as a tree, its objects as :class:`Pairs`."""

    top = staticmethod(lambda v: OBJECT if isinstance(v, Pairs) else LIST if isinstance(v, list) else v)

    @staticmethod
    def members(v):
        return (((name, n), x) for n, (name, x) in enumerate(v)) if isinstance(v, Pairs) else (((None, n), x) for n, x in enumerate(v))

    @staticmethod
    def unwrap(v):
        if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
            try:
                return deep.loads(v, Pairs)
            except ValueError:
                pass
        return v


def _one_form(v, path: tuple = ()):
    if isinstance(v, Pairs):
        out: dict = {}
        for name, x in v:
            if x is None:
                continue
            below = (*path, plain_name(name))
            child = RECORD_LISTS.get(below)
            y = [_item(key, item, child, below) for key, item in records(x, child, Trees)] if child else _one_form(x, below)
            # One owner is an object, as the schema has it.
            out[below[-1]] = y[0] if child == "owner" and len(y) == 1 else y
        return {k: y for k, y in out.items() if y not in ("", [], {})}
    return [_one_form(x, path) for x in v] if isinstance(v, list) else v


def _item(key: str | None, item, child: str, path: tuple):
    one = _one_form(item, path) if isinstance(item, Pairs) else {BARE.get(child, "value"): _one_form(item, path)}
    return one if key is None or "id" in one else {"id": key, **one}


def canonical(body: str | None) -> str | None:
    """The one form of a body as JSON; None if it is not a readable manifest."""
    try:
        root = deep.loads(body, Pairs) if body is not None else None
        return deep.plain_text(deep.dumps(_one_form(root), True)) if isinstance(root, Pairs) else None
    except (ValueError, RecursionError):
        return None


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else deep.dumps(v, True)


def _named(items: list, key: str) -> bool:
    names = [_text(i.get(key)) for i in items if isinstance(i, dict) and not isinstance(i.get(key), (dict, list))]
    return len(names) == len(items) == len(set(names)) and all(names)


def differences(a, b, path: str = "") -> Iterator[tuple[str, str, str | None, str | None]]:
    """``(field, change, before, after)`` of every field that differs; None is absent."""
    if a is None or b is None:
        if a is not None or b is not None:
            yield path, "added" if a is None else "removed", _text(a), _text(b)
    elif isinstance(a, dict) and isinstance(b, dict):
        for k in (*b, *(k for k in a if k not in b)):
            yield from differences(a.get(k), b.get(k), f"{path}.{k}" if path else k)
    else:
        if isinstance(a, list) and isinstance(b, list):
            key = next((k for k in LIST_KEYS if _named(a, k) and _named(b, k)), None)
            if key:
                x, y = ({_text(i[key]): i for i in side} for side in (a, b))
                for k in (*y, *(k for k in x if k not in y)):
                    yield from differences(x.get(k), y.get(k), f"{path}[{k}]")
                return
        # By JSON text, as 1 and true are not one.
        if type(a) is not type(b) or deep.dumps(a, True) != deep.dumps(b, True):
            yield path, "changed", _text(a), _text(b)


def _mapped(df: DataFrame, run, kept: int, fields: list[str]) -> DataFrame:
    """Rows of ``df`` through ``run``, a function from a row to rows, 64 at a time: its first ``kept``
    columns, then strings ``fields``."""

    def batches(bs):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        for b in bs:
            types, names = [*b.schema.types[:kept], *(pa.string() for _ in fields)], [*b.schema.names[:kept], *fields]
            for at in range(0, b.num_rows, 64):
                rows = [r for x in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)) for r in run(x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.mapInArrow(batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:kept]), *(f"{c} string" for c in fields)]))


def _with_earlier(states: DataFrame, *values: str) -> DataFrame:
    """Each state with ``e``, the one before of its feature: by version, then by load.

    The lag runs within (feature, version) and, over one row per version, between versions.
    """
    order = ["loaded_at", "manifest_id", *values]
    row = F.struct("version", *order)
    at = states.withColumn("v", F.coalesce(F.col("version").cast("long"), F.lit(-(2**63) + 1)))
    last = at.groupBy("feature_id", "v").agg(F.max(row).alias("l"))
    carried = last.select("feature_id", "v", F.lag("l").over(Window.partitionBy("feature_id").orderBy("v")).alias("c"))
    near = at.withColumn("p", F.lag(row).over(Window.partitionBy("feature_id", "v").orderBy(*order))).join(carried, ["feature_id", "v"])
    return near.withColumn("e", F.coalesce("p", "c")).drop("v", "p", "c")


def manifest_changes(features: DataFrame) -> DataFrame:
    """``feature_id, from_version, version, from_manifest, manifest_id, field, change, before, after``:
    each change between a manifest and the one before it, whatever happens later.

    Fields of the body by path; ``row.status`` and ``row.source_path`` are the table's own
    columns. A body that cannot be read is told once (``unreadable``) and the next readable one
    is compared with the last readable one. Rows without feature are left out.
    """
    rows = features.where("feature_id IS NOT NULL").select("feature_id", "version", "loaded_at", "manifest_id", "status", "source_path", F.col("body").cast("string").alias("body"))
    found = cut(_mapped(rows, lambda r: [(*r[:-1], canonical(r[-1]))], 6, ["form"]))
    states = found.withColumn("sig", F.sha2("form", 256))
    pair = [F.col("e.version").alias("from_version"), "version", F.col("e.manifest_id").alias("from_manifest"), "manifest_id"]

    columns = _with_earlier(states.select("feature_id", "version", "loaded_at", "manifest_id", "status", "source_path").distinct(), "status", "source_path").where("e IS NOT NULL")
    own = columns.select("feature_id", *pair, F.inline(F.array(*(F.struct(F.lit(f"row.{c}").alias("field"), F.col(f"e.{c}").alias("before"), F.col(c).alias("after")) for c in ("status", "source_path")))))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    own = own.where(~F.col("before").eqNullSafe(F.col("after"))).select(*PAIR, "field", change.alias("change"), "before", "after")

    slim = states.where("sig IS NOT NULL").select("feature_id", "version", "loaded_at", "manifest_id", "sig").distinct()
    moved = _with_earlier(slim, "sig").where("e.sig <> sig").select("feature_id", *pair, F.col("e.sig").alias("old_sig"), "sig")
    # Only bodies that differ are brought together; each form is held once.
    forms = states.where("sig IS NOT NULL").groupBy("sig").agg(F.min("form").alias("form"))
    both = moved.join(forms.select(F.col("sig").alias("old_sig"), F.col("form").alias("old_form")), "old_sig").join(forms, "sig").select(*PAIR, "old_form", "form")
    inner = _mapped(both, lambda r: ((*r[:-2], *d) for d in differences(deep.loads(r[-2]), deep.loads(r[-1]))), len(PAIR), ["field", "change", "before", "after"])

    none = F.lit(None).cast("string")
    bad = states.where("sig IS NULL").select("feature_id", F.lit(None).cast("int").alias("from_version"), "version", F.lit(None).cast("long").alias("from_manifest"), "manifest_id", F.lit("").alias("field"), F.lit("unreadable").alias("change"), none.alias("before"), none.alias("after")).distinct()
    return own.unionByName(inner).unionByName(bad)
