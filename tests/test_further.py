"""Operators of plans.further that SQL cannot express, and edge cases, against plain Python."""

import random

from pyspark.sql import functions as F

from weftline.operators import graph, joins


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_paths(edges, root):
    """Shortest paths from a root, neighbours in order of their names."""
    got, level = {root: [root]}, [root]
    while level:
        step = {}
        for n in level:
            for d in sorted({d for s, d in edges if s == n}):
                if d not in got:
                    p = got[n] + [d]
                    if d not in step or p < step[d]:
                        step[d] = p
        got |= step
        level = sorted(step, key=lambda d: step[d])
    return got


def test_paths_by_mode(spark):
    rnd = random.Random(5)
    nodes = [f"n{i:02}" for i in range(14)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes), rnd.choice(["sync", "sync", "async", "unknown"])) for _ in range(26)})
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(60)})
    want = {}
    for r, t in pairs:
        for mode, kinds in graph.MODES:
            p = brute_paths([(s, d) for s, d, k in edges if k in kinds], r).get(t)
            if p:
                by = [min((("sync", "async", "unknown").index(k), k) for s, d, k in edges if (s, d) == hop and k in kinds)[1] for hop in zip(p, p[1:])]
                at = by.index("unknown") + 1 if "unknown" in by else None
                want[r, t] = (mode, len(p) - 1, " > ".join(p), at, "unknown_from_hop" if at else "complete")
                break
        else:
            want[r, t] = (None, None, None, None, "unreached")
    got = graph.paths_by_mode(frame(spark, edges + [(None, "n01", "sync")], "src string, dst string, kind string"), frame(spark, pairs + [(None, "n01"), pairs[0]], "root string, target string"))
    rows = got.collect()
    assert {(r["root"], r["target"]): tuple(r)[2:] for r in rows} == want and len(rows) == len(want)
    assert {m for m, *_ in want.values()} >= {"sync", "async", None}
    none = frame(spark, [], "root string, target string")
    assert graph.paths_by_mode(frame(spark, edges, "src string, dst string, kind string"), none).count() == 0


def test_killers(spark):
    breaks = frame(spark, [("p", "pkg.test_a"), ("p", "Other::test_b()"), ("q", "test_c"), ("q", None), (None, "test_a")], "promise string, failed string")
    ver = frame(spark, [("p", "x.pkg.test_a"), ("p", "pkg.test_z"), ("q", "m.test_c"), ("q", "x.pkg.test_a"), ("p", None)], "promise string, verifier string").withColumn("case", F.lit("clash"))
    got = {(r["promise"], r["verifier"]): r["killed"] for r in joins.killers(breaks, ver).collect()}
    assert got == {("p", "x.pkg.test_a"): True, ("p", "pkg.test_z"): False, ("q", "m.test_c"): True, ("q", "x.pkg.test_a"): False}
    two = frame(spark, [("p", "a.test_a"), ("p", "b.test_a")], "promise string, failed string")
    assert [r["killed"] for r in joins.killers(two, frame(spark, [("p", "c.test_a")], "promise string, verifier string")).collect()] == [None]
    assert joins.killers(breaks.where("1 = 0"), ver).where("killed").count() == 0


def test_aliases_and_policies(spark):
    ids = frame(spark, [("a",), ("b",), ("c",), ("job:a",), (None,), ("a",)], "id string")
    known = frame(spark, [("job:a",), ("api:a",), ("job:b",), (None,)], "id string")
    prefixes = frame(spark, [("job:", 2), ("api:", 1)], "prefix string, rank int")
    assert {r["id"]: r["resolved"] for r in joins.resolve_ids(ids, known, prefixes).collect()} == {"a": "api:a", "b": "job:b", "c": None, "job:a": "job:a"}
    subjects = frame(spark, [("t", "read", r) for r in ("own", "sure", "maybe", "none")] + [("t", None, "own"), ("u", "read", "none"), ("w", "read", "none"), (None, "read", "own")], "object string, op string, role string")
    on = frame(spark, [("t",), ("w",)], "object string")
    pol = frame(spark, [("t", "read", "own", False), ("t", None, "g", None), ("t", "read", "none", True), ("t", "write", "none", False), ("w", "read", "public", False)], "object string, op string, role string, restrictive boolean")
    mem = frame(spark, [("sure", "g", True), ("sure", "g", False), ("maybe", "g", False)], "role string, of string, certain boolean")
    got = {(r["object"], r["op"], r["role"]): r["state"] for r in joins.policy_test(subjects, on, pol, mem).collect()}
    assert got == {("t", "read", "own"): "allowed", ("t", "read", "sure"): "allowed", ("t", "read", "maybe"): "unknown", ("t", "read", "none"): "denied", ("t", None, "own"): "denied", ("u", "read", "none"): "allowed", ("w", "read", "none"): "allowed"}


def test_walks_and_flows(spark):
    steps = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), (None, "a")], "src string, dst string")
    start = frame(spark, [("a",), ("x",), ("s",), ("lone",), (None,), ("a",)], "node string")
    assert sorted(map(tuple, graph.walks(steps, start).collect())) == [("a", 2, "c", "end"), ("lone", 0, "lone", "end"), ("s", 0, "s", "loop"), ("x", 2, "z", "loop")]
    assert graph.walks(steps, start.where("1 = 0")).count() == 0
    feats = frame(spark, [("a", "f"), ("b", "f"), ("c", "g"), ("y", None)], "node string, feature string")
    assert sorted(map(tuple, graph.flows(steps, start, feats, 1).collect())) == [("a", "f", 2, "a"), ("a", "g", 1, "c")]


def test_coloaded_and_certainty(spark):
    imports = frame(spark, [("app", "a"), ("app", "m"), ("m", "b"), ("other", "c"), ("b", "a")], "src string, dst string")
    pairs = frame(spark, [("a", "b"), ("a", "c"), ("m", "app"), ("c", "c"), (None, "a")], "a string, b string")
    assert sorted(map(tuple, graph.coloaded(imports, pairs).collect())) == [("a", "b"), ("c", "c"), ("m", "app")]
    seeds = frame(spark, [("r", "x")], "node string, role string")
    edges = lambda *e: frame(spark, list(e), "src string, dst string")
    got = {r["node"]: r["certain"] for r in graph.certainty(edges(("r", "g")), edges(("g", "h"), ("h", "g")), seeds, "role").collect()}
    assert got == {"r": True, "g": True, "h": False}


def test_dependencies(spark):
    import json

    from weftline.plans import further

    rows = [(1, "a", ["b", "gone"]), (2, "b", ["c"]), (3, "c", "a"), (4, "d", ["a"]), (5, None, ["a"]), (6, "e", ["e"])]
    feats = frame(spark, [(i, f, json.dumps({"DependsOn": d})) for i, f, d in rows], "manifest_id long, feature_id string, body string")
    got = sorted(map(tuple, further.q12_dependencies({"features": feats}.get).collect()))
    assert got == [("DEPENDS_ON_CYCLE", x) for x in "abce"] + [("DEPENDS_ON_MISSING", "a > gone")]


def test_first_of(spark):
    from weftline.operators import aggregates

    df = frame(spark, [("k", f"v{i % 40:02}") for i in range(100)] + [("one", "x"), ("none", None), (None, "y")], "key string, v string")
    got = {r["key"]: tuple(r)[1:] for r in aggregates.first_of(df, ["key"], "v", 3, "head").collect()}
    assert got == {"k": ("v00,v01,v02", 40, 37), "one": ("x", 1, 0), None: ("y", 1, 0)}


def test_template_join_loses_no_case(spark):
    import re

    rnd = random.Random(9)
    title = lambda w: "-".join(rnd.choice(w) for _ in range(rnd.randrange(1, 5)))
    templates = {f"{rnd.choice(['a.b', 'a'])}.{title(['_', '_', 'add', 'sub', 'x+'])}" for _ in range(60)} | {"_", "add-_"}
    cases = {f"{rnd.choice(['a.b', 'a'])}.{title(['add', 'sub', 'x+', 'x', '1'])}" for _ in range(80)} | {"add-one", "add"}
    split = lambda s: (s.rpartition(".")[0], s.rpartition(".")[2])
    pattern = lambda t: "-".join(r"[a-z0-9]+?(?:-[a-z0-9]+)*?" if p == "_" else re.escape(p) for p in t.split("-"))
    want = {(t, c) for t in templates if "_" in split(t)[1].split("-") for c in cases if split(t)[0] == split(c)[0] and re.fullmatch(pattern(split(t)[1]), split(c)[1])}
    got = [tuple(r) for r in joins.template_join(frame(spark, [(t,) for t in templates], "ref string"), frame(spark, [(c,) for c in cases], "case string"), "ref", "case").collect()]
    assert set(got) == want and len(got) == len(want) > 20
