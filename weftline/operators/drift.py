"""Schemas that drift between files (problem 1), by similarity flooding.

Each collection of a file becomes a schema graph: fields, hung by object or list links under
their parent, with links to the types found and to the values the records hold. Of two
consecutive schemas that differ the graphs are flooded: pairs of fields start with the similarity
of their names and the share of common records in which their values agree, and pass scores along
equal links until they settle. Equal paths stand by themselves. Of the others those pairs are
selected that are nearly the best both for the old and the new field; only they can be renames,
and an exact comparison of the values confirms them. Correspondences over all files, taken
together without contradiction, name the columns of one table into which all records are cast and
united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.deep import canonical, dumps, loads, plain_text
from weftline.functions.scale import checked_broadcast, cut, small_or_none

TYPES = ("string", "number", "boolean", "object", "array")
#: Flooding ends when no score moves by more, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-4, 200
#: A pair is selected if its score is this share of the best of its old field and of its new field.
SELECTED = 0.4
COLLECTIONS = ("blocks", "brds")
PROFILE = "file_id long, repo string, generated_at timestamp_ntz, schema_version string, collection string, sig string, records string"
CHANGES = "file_id long, collection string, field string, change string, new_field string, score double"


def kind_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(v)]


class Field:
    """A field of a schema: its parent (b"" for the records themselves), how many lists lie between
    both, its name, the types found, and a digest of all names and lists down to it (its path)."""

    __slots__ = ("id", "parent", "lists", "name", "types", "kids")

    def __init__(self, id: bytes, parent: bytes, lists: int, name: str):
        self.id, self.parent, self.lists, self.name, self.types, self.kids = id, parent, lists, name, set(), []


Schema = dict[bytes, Field]


def schema_of(records: list) -> Schema:
    """The fields of a list of records by path digest, each behind its parent."""
    fields: Schema = {b"": Field(b"", b"", 0, "")}
    known: dict[tuple[bytes, int, str], Field] = {}
    todo = [(r, b"", 0) for r in reversed(records) if isinstance(r, dict)]
    while todo:
        x, parent, lists = todo.pop()
        if isinstance(x, list):
            todo += [(y, parent, lists if isinstance(y, dict) else lists + 1) for y in reversed(x) if isinstance(y, (dict, list))]
            continue
        for k, v in x.items():
            f = known.get((parent, lists, k))
            if f is None:
                digest = hashlib.blake2b(b"%s%d." % (parent, lists) + k.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                f = known[parent, lists, k] = fields[digest] = Field(digest, parent, lists, k)
                fields[parent].kids.append(f)
            t = kind_of(v)
            if t is not None:
                f.types.add(t)
                if t == "object":
                    todo.append((v, f.id, 0))
                elif t == "array":
                    todo.append((v, f.id, 1))
    del fields[b""]
    return fields


def path_of(fields: Schema, id: bytes) -> str:
    """A field's path: `a.b` within objects, `a[].b` within lists of objects."""
    parts: list[str] = []
    while id:
        f = fields[id]
        parts.append(("[]" * f.lists + "." if f.parent else "") + f.name)
        id = f.parent
    return "".join(reversed(parts))


def signature(fields: Schema) -> str:
    """Equal for equal sets of paths and types."""
    h = hashlib.md5()
    for f in sorted(fields.values(), key=lambda f: f.id):
        h.update(f.id + ",".join(sorted(f.types)).encode() + b";")
    return h.hexdigest()


def _value(record: dict, keys: list[str]):
    """(carried, value) of a path outside lists."""
    for k in keys:
        if not isinstance(record, dict) or k not in record:
            return False, None
        record = record[k]
    return True, record


def _keys(fields: Schema, id: bytes) -> list[str]:
    keys: list[str] = []
    while id:
        keys.append(fields[id].name)
        id = fields[id].parent
    return keys[::-1]


def _outside(fields: Schema, id: bytes) -> bool:
    """Whether a field lies outside lists."""
    while id:
        if fields[id].lists:
            return False
        id = fields[id].parent
    return True


def _grams(name: str) -> set[str]:
    s = f"^{name.replace('_', '').lower()}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def likeness(a: str, b: str) -> float:
    """Similarity of two names, from 0 to 1, by pairs of letters."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


@dataclass
class Pairs:
    """The pairwise connectivity graph of two schemas. Each pair of fields hangs below the pair of
    their parents. Fields of one path make one pair; a removed and an added field of one parent
    make one, and so do those of one name below such a pair."""

    nodes: list[tuple[Field, Field]]
    up: list[int]
    candidates: list[int]


def pair_graph(old: Schema, new: Schema, gone: list[Field], come: list[Field]) -> Pairs:
    root = Field(b"", b"", 0, "")
    nodes, up, at = [(root, root)], [0], {b"": 0}
    for id, f in old.items():
        if id in new:
            at[id] = len(nodes)
            nodes.append((f, new[id]))
            up.append(at[f.parent])
    by_parent: dict[bytes, list[Field]] = {}
    for n in come:
        by_parent.setdefault(n.parent, []).append(n)
    first = len(nodes)
    for r in gone:
        for n in by_parent.get(r.parent, ()):
            nodes.append((r, n))
            up.append(at[r.parent])
    out = Pairs(nodes, up, list(range(first, len(nodes))))
    todo = list(out.candidates)
    while todo:
        k = todo.pop()
        r, n = nodes[k]
        named = {(f.lists, f.name): f for f in n.kids}
        for f in r.kids:
            if (g := named.get((f.lists, f.name))) is not None:
                todo.append(len(nodes))
                nodes.append((f, g))
                up.append(k)
    return out


def agreement(old: Schema, new: Schema, pairs: list[tuple[Field, Field]], both: list[tuple[dict, dict]]) -> np.ndarray:
    """For each pair of fields outside lists: of the common records that hold either, the share in
    which both have the same value (told by a 64-bit hash)."""

    def values(fields: Schema, f: Field, side: int) -> np.ndarray:
        keys, out = _keys(fields, f.id), np.zeros(len(both), dtype=np.int64)
        for r, pair in enumerate(both):
            held, v = _value(pair[side], keys)
            out[r] = hash(canonical(v)) | 1 if held else 0
        return out

    x = {a.id: values(old, a, 0) for a, _ in pairs}
    y = {b.id: values(new, b, 1) for _, b in pairs}
    return np.array([((x[a.id] == y[b.id]) & (x[a.id] != 0)).sum() / max(1, ((x[a.id] != 0) | (y[b.id] != 0)).sum()) for a, b in pairs])


def flood(graph: Pairs, agree: np.ndarray) -> np.ndarray:
    """Settled scores of the pairs. They start with the likeness of their names and, for candidates,
    with how far their values agree (``agree``); each round a pair gets what it started with, what it
    has, its share of what its parents' pair has, what its children's pairs have, and its share of
    what the pairs of one type have in common."""
    n = len(graph.nodes)
    start = np.array([1.0, *(1.0 if a.name == b.name else likeness(a.name, b.name) for a, b in graph.nodes[1:])])
    start[graph.candidates] += agree
    up, listed = np.array(graph.up), np.array([min(a.lists, 1) for a, _ in graph.nodes])
    link = up * 2 + listed
    down = 1 / np.bincount(link[1:], minlength=2 * n)[link] if n > 1 else np.ones(1)
    typed = np.array([[t in a.types and t in b.types for t in TYPES] for a, b in graph.nodes], dtype=float)
    share = 1 / np.maximum(typed.sum(0), 1)
    s, of_type = start / start.max(), np.ones(len(TYPES))
    down[0] = 0
    for _ in range(MOST_ROUNDS):
        below = np.bincount(up[1:], weights=s[1:], minlength=n)
        moved = start + s + s[up] * down + below + typed @ (of_type * share)
        moved /= moved.max()
        of_type = of_type + typed.T @ s
        of_type /= of_type.max()
        gap = np.abs(moved - s).max()
        s = moved
        if gap < SETTLED:
            break
    return s


def select(pairs: list[tuple[Field, Field]], score: np.ndarray, share: float = SELECTED) -> list[int]:
    """The pairs whose score is at least ``share`` of the best of their old and of their new field. A
    pair of equal values starts with 1 of at most 2, so it cannot fall behind a rival by much."""
    best: dict[tuple[int, bytes], float] = {}
    for (a, b), s in zip(pairs, score):
        for key in ((0, a.id), (1, b.id)):
            best[key] = max(best.get(key, 0.0), s)
    return [k for k, ((a, b), s) in enumerate(zip(pairs, score)) if s > 0 and s >= share * max(best[0, a.id], best[1, b.id])]


def correspondences(old: Schema, new: Schema, gone: list[Field], come: list[Field], both: list[tuple[dict, dict]]) -> Iterator[tuple[Field, Field, float]]:
    """The pairs of a removed and an added field that the settled scores select, in the order given."""
    graph = pair_graph(old, new, gone, come)
    pairs = [graph.nodes[k] for k in graph.candidates]
    if pairs:
        score = flood(graph, agreement(old, new, pairs, both))[graph.candidates]
        for k in select(pairs, score):
            yield *pairs[k], float(score[k])


def compare(before: list, after: list) -> list[tuple[str, str, str, float]]:
    """Changes ``(field, change, new_field, score)`` from one list of records to the next."""
    old, new = schema_of(before), schema_of(after)
    # Below a removed or an added field nothing is reported, so those whose parents both have are enough.
    removed = [f for id, f in old.items() if id not in new and (not f.parent or f.parent in new)]
    added = [f for id, f in new.items() if id not in old and (not f.parent or f.parent in old)]
    removed, added = sorted(removed, key=lambda f: path_of(old, f.id)), sorted(added, key=lambda f: path_of(new, f.id))
    by_id = lambda rows: {canonical(r["id"]): r for r in rows if isinstance(r, dict) and r.get("id") is not None}
    cases: dict[bytes, tuple[str, bytes, float]] = {id: ("retyped", b"", 0.0) for id in old.keys() & new.keys() if old[id].types and new[id].types and old[id].types != new[id].types}
    taken: set[bytes] = set()
    gone, come = [f for f in removed if _outside(old, f.id)], [f for f in added if _outside(new, f.id)]
    if gone and come:
        x, y = by_id(before), by_id(after)
        both = [(x[i], y[i]) for i in x.keys() & y.keys()]
        for r, n, s in correspondences(old, new, gone, come, both) if both else ():
            # Of the same types; then the values themselves.
            if r.id in cases or n.id in taken or r.types != n.types:
                continue
            kr, kn, carried = _keys(old, r.id), _keys(new, n.id), 0
            for o, w in both:
                (in_o, vo), (in_w, vw) = _value(o, kr), _value(w, kn)
                if in_o != in_w or in_o and canonical(vo) != canonical(vw):
                    carried = 0
                    break
                carried += in_o
            if carried:
                taken.add(n.id)
                cases[r.id] = ("renamed", n.id, s)
    for f in removed:
        cases.setdefault(f.id, ("removed", b"", 0.0))
    for f in added:
        if f.id not in taken:
            cases[f.id] = ("added", b"", 0.0)
    roots = set(cases) | taken
    # Parents stand before their children, so one look at the parent tells for the whole line.
    hidden: set[bytes] = set()
    for fields in (old, new):
        for id, f in fields.items():
            if f.parent in roots or f.parent in hidden:
                hidden.add(id)
    out = []
    for id, (change, to, s) in cases.items():
        if id not in hidden:
            out.append((path_of(old if id in old else new, id), change, path_of(new, to), s))
    return sorted(out)


def _pieces(part, fields: list[str]):
    for row in part.to_pylist():
        try:
            body = loads(row["body"]) if row["body"] is not None else None
        except ValueError:
            continue
        if not isinstance(body, dict):
            continue
        for c in COLLECTIONS:
            records = body.get(c)
            records = [records] if isinstance(records, dict) and records else records
            if isinstance(records, list) and records:
                yield *(row[k] for k in fields), c, signature(schema_of(records)), plain_text(dumps(records))


def profiles(files: DataFrame) -> DataFrame:
    """Each non-empty collection of each readable file with the signature of its schema, one row
    per file and collection. Unreadable bodies and rows without file_id or repo are left out."""
    fields = ["file_id", "repo", "generated_at", "schema_version"]

    def parse(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                rows = list(_pieces(b.slice(at, 32), fields))
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*fields, "collection", "sig", "records"])

    rows = files.where("file_id IS NOT NULL AND repo IS NOT NULL").select(F.col("file_id").cast("long"), "repo", F.col("generated_at").cast("timestamp_ntz"), "schema_version", "body")
    return rows.mapInArrow(parse, PROFILE)


def consecutive(slim: DataFrame) -> DataFrame:
    """Each collection with the signature and id of the latest earlier one of its repo.

    The lag runs within (repo, collection, day) and, over one row per day, between days: a
    repo of a third of all files is no single task.
    """
    keys, order = ["repo", "collection"], ["generated_at", "file_id"]
    day = slim.withColumn("day", F.coalesce(F.to_date("generated_at"), F.to_date(F.lit("0001-01-01"))))
    lasts = day.groupBy(*keys, "day").agg(F.max(F.struct(*order, "sig")).alias("l"))
    carried = lasts.select(*keys, "day", F.lag("l").over(Window.partitionBy(*keys).orderBy("day")).alias("c"))
    w = Window.partitionBy(*keys, "day").orderBy(*order)
    near = day.withColumn("p", F.lag(F.struct(*order, "sig")).over(w)).join(carried, [*keys, "day"])
    earlier = F.coalesce("p", "c")
    return near.select("file_id", *keys, "sig", earlier.file_id.alias("old_id"), earlier.sig.alias("old_sig"))


def field_changes(found: DataFrame) -> DataFrame:
    """Every field change with the file it first shows in, from :func:`profiles` rows.

    Only pairs of files whose schemas differ are brought together with their records.
    """
    slim = found.groupBy("file_id", "collection").agg(F.max(F.struct("repo", "generated_at", "sig")).alias("m")).select("file_id", "collection", "m.*")
    pairs = consecutive(slim).where("old_id IS NOT NULL AND sig <> old_sig")
    held = found.groupBy("file_id", "collection", "sig").agg(F.min("records").alias("records"))
    full = pairs.join(held.withColumnRenamed("records", "after"), ["file_id", "collection", "sig"]).join(held.select(F.col("file_id").alias("old_id"), "collection", F.col("sig").alias("old_sig"), F.col("records").alias("before")), ["old_id", "collection", "old_sig"])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part, rows = b.slice(at, 32), []
                for r in part.to_pylist():
                    rows += [(r["file_id"], r["collection"], *(plain_text(x) if isinstance(x, str) else x for x in c)) for c in compare(loads(r["before"]), loads(r["after"]))]
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "collection", "field", "change", "new_field", "score"])

    return full.select("file_id", "collection", "before", "after").mapInArrow(run, CHANGES)


def changes(files: DataFrame) -> DataFrame:
    """All field changes of all repos: ``file_id, collection, field, change, new_field, score``."""
    return field_changes(cut(profiles(files)))


# ---- one consistent table -------------------------------------------------------------

#: Most distinct field names and renames that are brought together to name the columns; both
#: are schema vocabulary and don't grow with the rows. Beyond it the operator stops with an error.
MOST_NAMES = 20_000


def column_names(found: DataFrame, collection: str) -> tuple[dict[str, str], dict[str, set]]:
    """Canonical key for each path outside lists, and the types of each canonical top field.

    Renames seen in the files are taken by falling support (files, then mean score); one that
    would unite two names used side by side in some file contradicts them and is left out. The
    most frequent name of those united is the canonical one.
    """
    one = found.where(F.col("collection") == collection)
    renames = small_or_none(field_changes(found).where((F.col("change") == "renamed") & (F.col("collection") == collection)).groupBy("field", "new_field").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s")), MOST_NAMES)

    def fields(batches):
        for b in batches:
            rows = []
            for (sig, text, n) in zip(*(b.column(i).to_pylist() for i in range(3))):
                f = schema_of(loads(text))
                rows += [(sig, plain_text(path_of(f, p)), sorted(x.types), n) for p, x in f.items() if _outside(f, p)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.int64())], names=["sig", "path", "types", "n"])

    per_sig = one.groupBy("sig").agg(F.min("records").alias("records"), F.count(F.lit(1)).alias("n")).select("sig", "records", "n").mapInArrow(fields, "sig string, path string, types array<string>, n long")
    per_sig = cut(per_sig)
    names = small_or_none(per_sig.groupBy("path").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types")), MOST_NAMES)
    if renames is None or names is None:
        raise ValueError(f"more than {MOST_NAMES} field names in {collection}")
    used = {r["path"]: r["n"] for r in names}
    # Names can come together only within a component of the renames; within one, those of each file are compared.
    component = _components([(r["field"], r["new_field"]) for r in renames])
    beside: set[tuple[str, str]] = set()
    if component:
        near = per_sig.join(checked_broadcast(found.sparkSession.createDataFrame(sorted(component.items()), "path string, c int"), 2 * MOST_NAMES), "path").select("sig", "path", "c")
        pairs = near.join(near.withColumnRenamed("path", "other"), ["sig", "c"]).where("path < other").select("path", "other").distinct()
        both = small_or_none(pairs, MOST_NAMES)
        if both is None:
            raise ValueError(f"more than {MOST_NAMES} contradictions among the renames of {collection}")
        beside = {(r["path"], r["other"]) for r in both}
    group = {p: {p} for p in used}
    for r in sorted(renames, key=lambda r: (-r["n"], -r["s"], r["field"], r["new_field"])):
        g, h = group.setdefault(r["field"], {r["field"]}), group.setdefault(r["new_field"], {r["new_field"]})
        if g is not h and not any((min(x, y), max(x, y)) in beside for x in g for y in h):
            g |= h
            for x in h:
                group[x] = g
    best = {p: min(g, key=lambda x: (-used.get(x, 0), x)) for p, g in group.items()}
    kinds: dict[str, set] = {}
    for r in names:
        if "." not in r["path"]:
            kinds.setdefault(best[r["path"]], set()).update(r["types"])
    return {p: b.rpartition(".")[2] for p, b in best.items() if p != b}, kinds


def _components(links: list[tuple[str, str]]) -> dict[str, int]:
    """The connected component of each name."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    number: dict[str, int] = {}
    return {x: number.setdefault(top(x), len(number)) for x in list(up)}


def _renamed(record: dict, names: dict[str, str]) -> dict:
    """A record under canonical names; where two fields meet under one name, the later keeps its own."""
    top: dict = {}
    todo = [(record, "", top)]
    while todo:
        x, at, out = todo.pop()
        for k, v in x.items():
            name = names.get(f"{at}{k}", k)
            while name in out:
                name = k if name != k and k not in out else f"{name}_"
            out[name] = v
            if isinstance(v, dict):
                out[name] = {}
                todo.append((v, f"{at}{k}.", out[name]))
    return top


def _column(name: str, taken: set[str]) -> str:
    base = name
    while name.lower() in taken:
        name = f"{base}_" if name == base else f"{name}_"
    taken.add(name.lower())
    return name


def consistent_table(found: DataFrame, collection: str) -> DataFrame:
    """All records of a collection over all files under canonical names and widest types.

    Columns ``file_id, repo, generated_at`` then one per canonical field, in alphabetical
    order: long where all values are whole numbers that fit, double where all are numbers, boolean
    where all are booleans, else string (objects and lists as JSON text). Names that clash, also by
    case, get an underscore. Of several bodies of one file the least by its text counts.
    """
    names, kinds = column_names(found, collection)
    taken = {"file_id", "repo", "generated_at"}
    columns = [(k, _column(k, taken)) for k in sorted(kinds)]
    keys = [k for k, _ in columns]

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                out = []
                for r in b.slice(at, 32).to_pylist():
                    for rec in loads(r["records"]):
                        if isinstance(rec, dict):
                            flat = _renamed(rec, names)
                            cells = [flat.get(k) for k in keys]
                            out.append((r["file_id"], r["repo"], r["generated_at"], *(c if c is None or isinstance(c, str) else canonical(c) for c in cells)))
                if out:
                    cols = list(zip(*out))
                    types = [pa.int64(), pa.string(), pa.timestamp("us"), *[pa.string()] * len(keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "repo", "generated_at", *(f"c{i}" for i in range(len(keys)))])

    one = found.where(F.col("collection") == collection)
    held = one.groupBy("file_id").agg(F.min(F.struct("records", "repo", "generated_at")).alias("m")).select("file_id", "m.repo", "m.generated_at", "m.records")
    schema = ", ".join(["file_id long, repo string, generated_at timestamp_ntz", *(f"c{i} string" for i in range(len(keys)))])
    wide = cut(held.mapInArrow(rows, schema))
    numbers = [i for i, k in enumerate(keys) if kinds[k] == {"number"}]
    whole = wide.agg(*(F.bool_and(F.expr(f"c{i} IS NULL OR try_cast(c{i} AS bigint) IS NOT NULL AND c{i} NOT RLIKE '[.eE]'")).alias(f"c{i}") for i in numbers)).first() if numbers else {}

    def cast(i: int, key: str, name: str):
        if i in numbers:
            return F.expr(f"try_cast(c{i} AS {'bigint' if whole[f'c{i}'] else 'double'})").alias(name)
        return F.expr(f"try_cast(c{i} AS boolean)").alias(name) if kinds[key] == {"boolean"} else F.col(f"c{i}").alias(name)

    return wide.select("file_id", "repo", "generated_at", *(cast(i, k, n) for i, (k, n) in enumerate(columns)))


def consistent_tables(files: DataFrame) -> dict[str, DataFrame]:
    found = cut(profiles(files))
    return reduce(lambda d, c: d | {c: consistent_table(found, c)}, COLLECTIONS, {})
