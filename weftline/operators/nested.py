"""Deeply nested semi-structured records to flat linked tables (problem 5).

Each body is parsed as a stream of events into triples (path, value, ordinals): one for every
scalar and one for every object or list met on the way; no tree of it is built. The triples of a
body are grouped by their repeated ancestor (the path of the list they lie in), whatever shape the
list has there, and each group is pivoted into one table whose rows carry the ordinals of record
and parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import deep

#: The repeated ancestors of a manifest, by path of their names in lower case without `_`, with what one record is called.
RECORD_LISTS = {("capabilities",): "capability", ("invariants",): "invariant", ("capabilities", "rules"): "rule", ("invariants", "cases"): "case", ("owners",): "owner"}
#: Those of its lists whose elements are mere strings.
STRING_LISTS = {("capabilities", "counterexamples"): "counter_example", ("invariants", "verifiableby"): "verifiable_by", ("dependson",): "depends_on"}
#: Where a record may be a bare string, and the field the string stands for.
BARE = {"rule": "text", "owner": "business", "counter_example": "text", "verifiable_by": "text", "depends_on": "text"}
#: Fields by which one bare record is told from an object keyed by ID.
RECORD_FIELDS = {"id", "statement", "summary", "kind", "rules", "cases", "verifiableby", "counterexamples", "enforcer", "retired"}
TRIPLES = "doc long, child string, parent_ordinal int, ordinal int, path string, value string"
#: Values of the triples of objects and lists.
OBJECT, LIST = object(), object()
#: Steps of a path kept as they are: as many as lead to a field of the innermost records.
STEPS = 5
#: A step is a name (None in a list) and an ordinal in written order; steps beyond ``STEPS`` hang in a chain.
Step = tuple[str | None, int]
Triple = tuple[tuple[Step, ...], tuple | None, object]


def plain_name(name: str) -> str:
    """`VerifiableBy`, `verifiable_by` and `verifiableBy` are one field."""
    return name.replace("_", "").replace("-", "").strip().lower()


def stream(text: str) -> Iterator[Triple]:
    """The triples of a JSON text, in written order; ValueError if it isn't JSON."""
    open_: list[list] = []  # steps, further steps, ordinal of the last member
    steps, more = (), None
    for kind, x in deep.events(text):
        if kind == deep.CLOSE:
            open_.pop()
            continue
        if open_ and (kind == deep.KEY or open_[-1][3]):
            above = open_[-1]
            above[2] += 1
            step = (x if kind == deep.KEY else None, above[2])
            if len(above[0]) < STEPS:
                steps, more = (*above[0], step), None
            else:
                steps, more = above[0], (above[1], step)
            if kind == deep.KEY:
                continue
        yield steps, more, x if kind == deep.SCALAR else OBJECT if kind == deep.OPEN_OBJECT else LIST
        if kind != deep.SCALAR:
            open_.append([steps, more, 0, kind == deep.OPEN_LIST])


def _members(value: list[Triple]) -> Iterator[tuple[Step, list[Triple]]]:
    """The members of an object or list, each with its own triples."""
    for step, own in groupby(value[1:], key=lambda t: t[0][0]):
        yield step, [(steps[1:], more, v) for steps, more, v in own]


def _unwrap(value: list[Triple]) -> list[Triple]:
    """The triples of the JSON text of a list or object, where a string is one."""
    v = value[0][2]
    if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
        try:
            return list(stream(v))
        except ValueError:
            return value
    return value


class Spans:
    """A JSON value as the triples of a stream: what stands at its top, its members, and what a
    string that is the JSON text of a list or object stands for."""

    top = staticmethod(lambda value: value[0][2])
    members = staticmethod(_members)
    unwrap = staticmethod(_unwrap)


def records(value, child: str, view=Spans) -> Iterator[tuple[str | None, object]]:
    """The records of a list in any of its shapes, as (key, record).

    An array, one bare object, an object keyed by ID in written order, a bare string where
    one may stand, or JSON text of these. Null elements and blank strings are no records.
    """
    value = view.unwrap(value)
    if view.top(value) is OBJECT:
        members = list(view.members(value))
        tops = [view.top(own) for _, own in members]
        keyed = members and child != "owner" and all(t is None or t is OBJECT or child == "rule" for t in tops) and not {plain_name(name) for (name, _), _ in members} & RECORD_FIELDS
        if keyed:
            yield from ((name, own) for ((name, _), own), t in zip(members, tops) if t is not None)
        elif members or child == "owner":
            yield None, value
        return
    for item in (own for _, own in view.members(value)) if view.top(value) is LIST else [value]:
        item = view.unwrap(item)
        v = view.top(item)
        if v is None or isinstance(v, str) and (child not in BARE or not v.strip()):
            continue
        if v is OBJECT or isinstance(v, str) or child in BARE:
            yield None, item


def _field(record: list[Triple], name: str) -> list[Triple] | None:
    """The last value of a field, by plain name; null and absent are one."""
    found = None
    for (step, _), own in _members(record):
        if step is not None and plain_name(step) == name and own[0][2] is not None:
            found = own
    return found


def _text(v) -> str:
    return v if isinstance(v, str) else deep.dumps(v)


def _path(steps: tuple[Step, ...], more: tuple | None) -> str:
    parts: list[Step] = []
    while more:
        more, step = more
        parts.append(step)
    path = ""
    for name, n in (*steps, *reversed(parts)):
        path += f"[{n}]" if name is None else f"{'.' if path else ''}{plain_name(name)}"
    return path


def triples(body: str | None, lists: dict = RECORD_LISTS, fields: set[str] | None = None) -> Iterator[tuple[str, int, int, str, str | None]]:
    """``(child, parent_ordinal, ordinal, path, value)`` of a readable body; nothing of an unreadable one.

    Each record gives one triple with the empty path, whose value is its own key in a keyed
    object, then one for each scalar, by path within the record (``a.b``, ``a[2]``). Lists of records
    inside give their own triples instead. ``fields``: the paths that are wanted, all if None.
    """
    try:
        root = list(stream(body)) if body is not None else []
    except ValueError:
        return
    if not root or root[0][2] is not OBJECT:
        return
    deepest = max((f.count(".") + f.count("[") + 1 for f in fields), default=0) if fields is not None else None

    def inside(record: list[Triple], at: tuple, child: str, parent: int, ordinal: int):
        if record[0][2] is not OBJECT:
            if record[0][2] is not LIST and (fields is None or BARE.get(child, "value") in fields):
                yield child, parent, ordinal, BARE.get(child, "value"), _text(record[0][2])
            return
        for steps, more, v in record[1:]:
            if v is None or v is OBJECT or v is LIST or deepest is not None and (more or len(steps) > deepest):
                continue
            if (*at, plain_name(steps[0][0])) not in lists:
                path = _path(steps, more)
                if fields is None or path in fields:
                    yield child, parent, ordinal, path, _text(v)

    def walk(record: list[Triple], at: tuple, ordinal: int):
        for below, child in lists.items():
            if below[:-1] != at or record[0][2] is not OBJECT or (value := _field(record, below[-1])) is None:
                continue
            n = 0
            for key, item in records(value, child):
                if child == "owner" and not _business(item):
                    continue
                n += 1
                yield child, ordinal, n, "", key
                yield from inside(item, below, child, ordinal, n)
                yield from walk(item, below, n)

    yield from walk(root, (), 0)


def _business(owner: list[Triple]) -> bool:
    v = _field(owner, "business") if owner[0][2] is OBJECT else owner
    return v is not None and (v[0][2] is OBJECT or v[0][2] is LIST or str(v[0][2]).strip() != "")


def body_triples(df: DataFrame, id_col: str, body_col: str, lists: dict = RECORD_LISTS, fields: list[str] | None = None) -> DataFrame:
    """The triples of all bodies, one row each. One body is in memory at a time beside its batch."""
    wanted = None if fields is None else set(fields)

    def parse(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [(i, *t) for i, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for t in triples(body, lists, wanted)]
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([deep.plain_text(v) for v in c] if t == pa.string() else c, t) for c, t in zip(cols, types)], names=["doc", "child", "parent_ordinal", "ordinal", "path", "value"])

    return df.select(F.col(id_col).cast("long"), F.col(body_col).cast("string")).mapInArrow(parse, TRIPLES)


def pivot_records(found: DataFrame, fields: list[str]) -> DataFrame:
    """Pivot triples into one row per record, with a column for each of ``fields`` (null where
    absent, named ``f_...``) and ``key``, the record's key in a keyed object. Map tasks pre-aggregate."""
    last = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    need = found.where(F.col("path").isin("", *fields))
    return need.groupBy("doc", "child", "parent_ordinal", "ordinal").agg(last("").alias("key"), *(last(f).alias(f"f_{f}") for f in fields))


def one_per(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """Repeated rows once: the greatest of each key. Rows without key are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*keep)).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in keep))


def manifest_records(features: DataFrame, fields: list[str], lists: dict = RECORD_LISTS) -> DataFrame:
    """All nested records of all manifests with the given fields."""
    return pivot_records(body_triples(one_per(features, "manifest_id", "body"), "manifest_id", "body", lists, fields), fields)


#: The flat tables of a manifest: their records, what the parent's ordinal is called, and their fields.
TABLES = {
    "owners": ("owner", None, ("business", "engineering", "oncall")),
    "capabilities": ("capability", None, ("id", "kind", "summary")),
    "rules": ("rule", "capability", ("text",)),
    "counter_examples": ("counter_example", "capability", ("text",)),
    "invariants": ("invariant", None, ("id", "statement")),
    "verifiable_by": ("verifiable_by", "invariant", ("text",)),
    "cases": ("case", "invariant", ("id", "kind", "statement", "enforcer", "retired")),
    "depends_on": ("depends_on", None, ("text",)),
}


def manifest_table(features: DataFrame, name: str) -> DataFrame:
    """One of :data:`TABLES`: ``manifest_id``, the parent's ordinal where there is a parent (0 is the
    manifest itself), ``ordinal`` and the fields; absent values are null, an absent ID is the key."""
    child, parent, fields = TABLES[name]
    lists = {p: c for p, c in {**RECORD_LISTS, **STRING_LISTS}.items() if c in (child, parent)}
    rows = manifest_records(features, list(fields), lists).where(F.col("child") == child)
    keys = ["doc AS manifest_id", *([f"parent_ordinal AS {parent}_ordinal"] if parent else []), "ordinal"]
    return rows.selectExpr(*keys, *(f"coalesce(f_{f}, key) AS {f}" if f == "id" else f"f_{f} AS {f}" for f in fields))
