import json
import random

import numpy as np
from pyspark.sql import functions as F

from weftline import plans
from weftline.operators import drift

FILES = "file_id long, repo string, path string, generated_at timestamp_ntz, generated_from_commit string, schema_version string, body string, loaded_at timestamp_ntz"


def kinds(records):
    out = {}

    def go(v, p):
        if isinstance(v, dict):
            for k, x in v.items():
                q = f"{p}.{k}" if p else k
                t = {str: "s", bool: "b", int: "n", float: "n", dict: "o", list: "a"}.get(type(x))
                out.setdefault(q, set()).update([t] if t else [])
                go(x, q)
        elif isinstance(v, list):
            for x in v:
                go(x, p + "[]")

    for r in records:
        go(r, "")
    return out


MISSING = object()


def at(r, path):
    for k in path.split("."):
        if not isinstance(r, dict) or k not in r:
            return MISSING
        r = r[k]
    return r


def eq(a, b):
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(eq(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(eq, a, b))
    return a == b


def brute(old, new):
    a, b = kinds(old), kinds(new)
    gone, come = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    xs, ys = {r.get("id"): r for r in old}, {r.get("id"): r for r in new}
    cases, used = {p: ("retyped", "") for p in a.keys() & b.keys() if a[p] and b[p] and a[p] != b[p]}, set()
    head = lambda p: p.rpartition(".")[0]
    for g in gone:
        for c in come:
            if c in used or "[]" in g or "[]" in c or head(g) != head(c) or a[g] != b[c]:
                continue
            pairs = [(at(xs[i], g), at(ys[i], c)) for i in xs.keys() & ys.keys()]
            if any(p is not MISSING for p, _ in pairs) and all((p is MISSING) == (q is MISSING) and (p is MISSING or eq(p, q)) for p, q in pairs):
                used.add(c)
                cases[g] = ("renamed", c)
                break
    for g in gone:
        cases.setdefault(g, ("removed", ""))
    for c in come:
        if c not in used:
            cases[c] = ("added", "")
    tops = set(cases) | used
    inside = lambda p: any(p.startswith((t + ".", t + "[")) for t in tops)
    return sorted((p, k, n) for p, (k, n) in cases.items() if not inside(p))


def brute_all(rows):
    seen, by = set(), {}
    for fid, repo, when, body in rows:
        if fid in seen:
            continue
        seen.add(fid)
        try:
            j = json.loads(body)
        except (ValueError, TypeError):
            continue
        for c in ("blocks", "brds"):
            if isinstance(j, dict) and isinstance(j.get(c), list) and j[c]:
                by.setdefault((repo, c), []).append((when, fid, j[c]))
    out = []
    for (_, c), files in by.items():
        files.sort(key=lambda f: f[:2])
        for (_, _, o), (_, fid, n) in zip(files, files[1:]):
            out += [(fid, c, *case) for case in brute(o, n)]
    return sorted(out)


def test_changes_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/graph_files.parquet").select("file_id", "repo", "generated_at", "body").collect()]
    got = sorted(tuple(r) for r in plans.queries()["p1_found"](spark, sf).select("file_id", "collection", "field", "change", "new_field").collect())
    assert got == brute_all(rows) and len(got) > 50


def test_random_schemas_match_brute_force():
    rnd = random.Random(7)
    names = ["a", "b", "a_id", "alpha", "beta", "x"]

    def value(depth=0):
        n = rnd.randrange(8 if depth < 2 else 5)
        if n == 5:
            return {k: value(depth + 1) for k in rnd.sample(names, 2)}
        if n == 6:
            return [value(depth + 1) for _ in range(rnd.randrange(3))]
        return [1, 2.5, "s", True, None, "t", "u", 1][n]

    for _ in range(400):
        old = [{"id": str(i)} | {k: value() for k in rnd.sample(names, 3)} for i in range(2)]
        new = [dict(r) for r in old]
        for r in new:
            for k in list(r):
                if k != "id" and rnd.random() < 0.5:
                    r[rnd.choice(names)] = r.pop(k)
        assert [c[:3] for c in drift.compare(old, new)] == brute(old, new)


def test_edges(spark):
    body = lambda *r: json.dumps({"blocks": list(r)})
    rows = [
        (1, "r", None, None, None, None, body({"id": "1", "t": 1}), None), (1, "r", None, None, None, None, body({"id": "1", "t": 1}), None), (2, "r", None, None, None, None, None, None),
        (3, "r", None, None, None, None, "{", None), (4, "r", None, None, None, None, '{"blocks": NaN}', None), (5, "r", None, None, None, None, body({"id": "1", "u": 1}), None), (None, "r", None, None, None, None, body({"id": "1"}), None),
        (6, "r", None, None, None, None, "[]", None),
    ]
    df = spark.createDataFrame(rows, FILES).withColumn("collection", F.lit("clash")).withColumn("sig", F.lit(0))
    got = [tuple(r)[:5] for r in drift.changes(df).collect()]
    assert got == [(5, "blocks", "t", "renamed", "u")]
    assert drift.changes(spark.createDataFrame([], FILES)).count() == 0


def test_one_table_unites_renamed_columns(spark):
    body = lambda *r: json.dumps({"blocks": list(r)})
    rows = [(i, "r", None, None, None, None, body({"id": "1", "line": 3, "Line": "x"} if i < 3 else {"id": "1", "loc": 3, "Line": "x"}), None) for i in range(1, 5)]
    t = drift.consistent_table(drift.profiles(spark.createDataFrame(rows, FILES)), "blocks")
    assert t.columns == ["file_id", "repo", "generated_at", "Line", "id", "line_"]
    assert sorted((r["file_id"], r["line_"], r["Line"]) for r in t.collect()) == [(i, 3.0, "x") for i in range(1, 5)]


def test_the_scores_select_the_renames(monkeypatch):
    """Without the flood's scores, or with others, renames are lost; with them few pairs are compared by value."""
    rnd = random.Random(3)
    names = [f"{a}_{b}" for a in ("tier", "lines", "system", "layer", "title", "state") for b in ("no", "id", "kind", "text")]
    cases = []
    for _ in range(60):
        kept, gone, come = (lambda x: (x[:6], x[6:10], x[10:14]))(rnd.sample(names, 14))
        values = {n: [rnd.choice([str(rnd.randrange(1000)), f"{n}-{i}"]) for i in range(8)] for n in names}
        old = [{"id": str(i)} | {k: values[k][i] for k in (*kept, *gone)} for i in range(8)]
        renamed = dict(zip(gone[:2], come[:2]))
        new = [{"id": str(i)} | {k: values[k][i] for k in (*kept, *come[2:])} | {n: values[g][i] for g, n in renamed.items()} for i in range(8)]
        cases.append((old, new, renamed))
    found = lambda: [{c[0]: c[2] for c in drift.compare(o, n) if c[1] == "renamed"} for o, n, _ in cases]
    assert found() == [r for _, _, r in cases]
    tried = 0
    for o, n, _ in cases:
        a, b = drift.schema_of(o), drift.schema_of(n)
        gone, come = ([f for i, f in x.items() if i not in y] for x, y in ((a, b), (b, a)))
        tried += len(list(drift.correspondences(a, b, gone, come, list(zip(o, n)))))
    assert tried < 16 * len(cases) / 2
    flood = drift.flood
    monkeypatch.setattr(drift, "flood", lambda graph, agree: np.random.default_rng(1).permutation(flood(graph, agree)) ** 4)
    assert sum(map(len, found())) < sum(len(r) for _, _, r in cases) * 0.8
    monkeypatch.setattr(drift, "flood", lambda graph, agree: np.zeros(len(graph.nodes)))
    assert found() == [{}] * len(cases)


def test_selection():
    a, b, c, d = (drift.Field(bytes([i]), b"", 0, "f") for i in range(4))
    assert drift.select([(a, c), (a, d), (b, c), (b, d)], np.array([1.0, 0.2, 0.5, 0.9])) == [0, 2, 3]
    assert drift.select([], np.zeros(0)) == [] and drift.select([(a, c)], np.zeros(1)) == []


def test_paths_and_signatures():
    s = drift.schema_of([{"a": {"b": 1}, "c": [{"d": [[{"e": None}]]}]}, None, {"a": None, "f": []}])
    assert sorted(drift.path_of(s, i) for i in s) == ["a", "a.b", "c", "c[].d", "c[].d[][].e", "f"]
    same, other = drift.schema_of([{"f": [], "a": {"b": 2}}, {"c": [{"d": [[{"e": None}]]}]}]), drift.schema_of([{"f": "x", "a": {"b": 2}, "c": [{"d": [[{"e": None}]]}]}])
    assert drift.signature(s) == drift.signature(same) != drift.signature(other)


def test_very_deep_bodies_and_large_numbers(spark):
    deep = '{"a": [' * 10_000 + "1" + "]}" * 10_000
    body = lambda key: f'{{"blocks": [{{"id": "1", "{key}": {deep}, "n": 9007199254740993}}]}}'
    rows = [(i, "r", None, None, None, None, body(k), None) for i, k in enumerate(("deep", "deep", "deeper"))]
    files = spark.createDataFrame(rows, FILES)
    assert [tuple(r)[:5] for r in drift.changes(files).collect()] == [(2, "blocks", "deep", "renamed", "deeper")]
    got = drift.consistent_table(drift.profiles(files), "blocks").collect()
    assert {r["n"] for r in got} == {9007199254740993} and {len(r["deep"]) for r in got} == {len(deep)}


def test_fields_that_meet_under_one_name():
    assert drift._renamed({"a": 1, "b": 2, "c": {"a": 3}}, {"b": "a", "c.a": "z"}) == {"a": 1, "b": 2, "c": {"z": 3}}
    assert drift._components([("a", "b"), ("b", "c"), ("x", "y")]) == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1}
