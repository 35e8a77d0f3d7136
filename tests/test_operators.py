import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.functions import numbers, refs, text
from weftline.operators import aggregates, filters, graph, joins, sets


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_closure_and_cycles_match_brute_force(spark):
    rnd = random.Random(1)
    for n, m in ((8, 12), (12, 14)):
        pairs = list({(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)})
        e = edges(spark, [*pairs, ("n0", None)])
        got = {r["node"] for r in graph.closure(e, spark.createDataFrame([("n1",), (None,)], "node string")).collect()}
        assert got == reach(pairs, {"n1"})
        loops = {a for a in {x for p in pairs for x in p} if a in set().union(*(reach(pairs, {b}) for x, b in pairs if x == a), set())}
        assert {r["node"] for r in graph.cyclic(e).collect()} == loops
    assert graph.cyclic(edges(spark, [])).count() == 0 and graph.closure(edges(spark, []), spark.createDataFrame([], "node string")).count() == 0


def test_neighbourhood_directions(spark):
    e = spark.createDataFrame([("a", "k", "b"), ("b", "k", "c"), ("c", "k", "d")], "src string, kind string, dst string")
    s = spark.createDataFrame([("b",)], "node string")
    got = lambda d, n=1: sorted(r["src"] + r["dst"] for r in graph.neighbourhood(e, s, n, d).collect())
    assert got("out") == ["bc"] and got("in") == ["ab"] and got("both") == ["ab", "bc"] and got("out", 2) == ["bc", "cd"] and got("out", 99) == ["bc", "cd"]


def test_rapid_types_wake_candidates(spark):
    s = spark.createDataFrame([("root",)], "node string")
    maybe = spark.createDataFrame([("root", "T.m", "T"), ("root", "U.m", "U"), ("root", "x", None)], "src string, dst string, type string")
    got = {r["node"] for r in graph.rapid_types(edges(spark, [("root", "a"), ("a", "b"), ("b", "T"), ("T.m", "deep")]), maybe, s).collect()}
    assert got == {"root", "a", "b", "T", "T.m", "deep"}


def test_paths_chains_and_crossings(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "x"), ("x", "y")])
    s = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, graph.shortest_paths(e, s).collect())) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]
    done, rest = graph.peel(e)
    assert {(r["node"], r["level"]) for r in done.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)} and {r["node"] for r in rest.collect()} == {"x", "y"}
    c = graph.crossings(edges(spark, [("a", "b"), ("c", "d")]), edges(spark, [("b", "c"), ("a", "d")]), s)
    assert {(r["node"], r["crossings"]) for r in c.collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 1)}


def test_similar_sets_lose_nothing(spark):
    rnd = random.Random(2)
    own = {f"o{i:02}": set(rnd.sample(range(12), rnd.randrange(1, 7))) for i in range(50)}
    rows = [(o, m) for o, s in own.items() for m in s] + [("o00", None), (None, 3)]
    df = spark.createDataFrame(rows, "owner string, m int")
    reps = {}
    for o in sorted(own):
        reps.setdefault(frozenset(own[o]), o)
    assert {(r["owner"], r["class"]) for r in sets.set_classes(df, "owner", "m").collect()} == {(o, reps[frozenset(s)]) for o, s in own.items()}
    for least in (0.8, 0.5, 0.2):
        want = {(a, b) for a, b in combinations(sorted(reps.values()), 2) if len(own[a] & own[b]) / len(own[a] | own[b]) >= least - 1e-9}
        assert {(r["a"], r["b"]) for r in sets.similar_sets(df, "owner", "m", least).collect()} == want


def test_suffix_join_never_guesses(spark):
    r = spark.createDataFrame([("b/x.py",), ("x.py",), ("root/a/b/x.py",), (None,), ("y.py",)], "report string")
    f = spark.createDataFrame([("a/b/x.py",), ("c/x.py",)], "file string")
    got = {x["report"]: (x["file"], x["matches"]) for x in joins.suffix_join(r, f, "report", "file").collect()}
    assert got == {"b/x.py": ("a/b/x.py", 1), "x.py": (None, 2), "root/a/b/x.py": ("a/b/x.py", 1)}


def test_tail_match_scores_and_ties(spark):
    r = spark.createDataFrame([("pkg::A::test_x",), ("test_y",), ("B/test_z",), (None,)], "ref string")
    c = spark.createDataFrame([("A.test_x",), ("m.test_y",), ("n.test_y",), ("other.test_z",), ("root.b.test_z",)], "case string")
    got = {x["ref"]: (x["case"], x["candidates"]) for x in joins.tail_match(r, c, "ref", "case").collect()}
    assert got == {"pkg.a.test_x": ("a.test_x", 1), "test_y": (None, 2), "b.test_z": ("root.b.test_z", 1)}


def test_template_and_routes(spark):
    t = spark.createDataFrame([("suite.adds-_-and-_",), ("plain",)], "ref string")
    c = spark.createDataFrame([("suite.adds-1-and-two-three",), ("suite.adds-1",), ("other.adds-1-and-2",)], "case string")
    assert [tuple(x) for x in joins.template_join(t, c, "ref", "case").collect()] == [("suite.adds-_-and-_", "suite.adds-1-and-two-three")]
    calls = spark.createDataFrame([("GET", "/a/7"), ("POST", "/a/7"), ("GET", "/a/b"), ("GET", "/a"), ("GET", None)], "method string, path string")
    routes = spark.createDataFrame([("GET", "/a/{id}"), ("GET", "/a/b"), (None, "/:x/7")], "method string, path string")
    got = {(x["method"], x["path"]): x["outcome"] for x in joins.route_join(calls, routes).collect()}
    assert got == {("GET", "/a/7"): "ambiguous", ("POST", "/a/7"): "edge", ("GET", "/a/b"): "ambiguous", ("GET", "/a"): "no_route"}


def test_interval_and_overlap(spark):
    p = spark.createDataFrame([("f", 1), ("f", 5), ("f", 900), ("g", 5), ("f", None)], "file string, at int")
    s = spark.createDataFrame([("f", "a", 1, 900), ("f", "b", 4, 5), ("f", "c", 5, 5), ("f", "d", None, 5)], "file string, fqn string, lo int, hi int")
    j = joins.interval_join(p, s, ["file"], "at", "lo", "hi", 64.0)
    assert sorted((x["at"], x["fqn"]) for x in j.collect()) == [(5, "a"), (5, "b"), (900, "a")]
    assert sorted((x["at"], x["fqn"]) for x in joins.innermost(j, ["file", "at"], "lo", "hi", "fqn").collect()) == [(5, "b"), (900, "a")]
    a = spark.createDataFrame([("f", 1, 500)], "file string, a int, b int")
    b = spark.createDataFrame([("f", 500, 600), ("f", 501, 600), ("g", 1, 2)], "file string, c int, d int")
    assert joins.overlap_join(a, b, ["file"], "a", "b", "c", "d").count() == 1


def test_folds(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", None, None), ("b", "y", False), ("c", None, None)], "k string, v string, yes boolean")
    got = {r["k"]: r["f"] for r in df.groupBy("k").agg(aggregates.three_valued(F.col("yes"), F.col("yes").isNotNull()).alias("f")).collect()}
    assert got == {"a": "yes", "b": "no", "c": "unknown"}
    assert {(r["k"], r["v"]) for r in aggregates.worst_of(df, ["k"], "v", ("y", "x")).collect()} == {("a", "x"), ("b", "y"), ("c", None)}
    assert {(r["v"], r["n"]) for r in aggregates.filled_counts(df, "v", ("x", "y", "z")).collect()} == {("x", 1), ("y", 1), ("z", 0)}
    log = spark.createDataFrame([("s", 1, "create", "a", None), ("s", 2, "rename", "a", "b"), ("s", 3, "create", "c", None), ("s", 4, "drop", "c", None), ("s", 5, "rename", "gone", "x")], "k string, n int, op string, name string, to string")
    assert [tuple(r) for r in aggregates.replay(log, ["k"], ["n"], "op", "name", "to").collect()] == [("s", "b")]
    assert {(r["k"], r["v"], r["n"]) for r in aggregates.mode(spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None)], "k string, v string"), ["k"], "v").collect()} == {("a", "x", 1)}
    assert [r["ranges"] for r in aggregates.compact_ranges(spark.createDataFrame([("k", n) for n in (12, 13, 14, 20, 20)] + [("k", None)], "k string, n int"), ["k"], "n").collect()] == ["12-14, 20"]


def test_prefix_overlaps_and_cascade(spark):
    s = spark.createDataFrame([("a", "src/x/"), ("b", "src/x/y"), ("a", "src/z"), ("c", "src/xy"), (None, "src"), ("d", "")], "owner string, path string")
    assert [(r["path"], r["under"]) for r in joins.prefix_overlaps(s, "owner", "path").collect()] == [("src/x", 1)]
    t1 = spark.createDataFrame([("r", "one"), ("q", "p"), ("q", "p2")], "k string, t string")
    t2 = spark.createDataFrame([("r", "other"), ("s", "two"), ("q", "three")], "k string, t string")
    got = {r["ref"]: (r["target"], r["basis"]) for r in joins.first_resolved(spark.createDataFrame([("r",), ("s",), ("q",), ("z",)], "ref string"), "ref", [("a", t1, "k", "t"), ("b", t2, "k", "t")]).collect()}
    assert got == {"r": ("one", "a"), "s": ("two", "b"), "q": (None, "a"), "z": (None, "missing")}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    lit = F.lit
    assert one(text.slug(lit("Ab  c!"))) == "ab-c" and one(text.slug(lit("!"))) == "test"
    assert one(text.dotted(lit("A::b/C#d (e)"))) == "a.b.c.d.e"
    assert one(numbers.percent(lit(0), lit(0))) == 100.0 and one(numbers.ratio(lit(1), lit(3))) == 0.3333 and one(numbers.ratio(lit(1), lit(0))) == 0.0
    assert one(numbers.extent_length(lit("12-14"))) == 3 and one(numbers.extent_length(lit("7"))) == 1 and one(numbers.extent_length(lit("x"))) is None
    assert one(refs.scope(lit("a:b:c"), lit("o"))) == "a:b" and one(refs.scope(lit(":c"), lit("o"))) == "o" and one(refs.item(lit("a:c"))) == "c"
    assert one(refs.case_label(lit("INV-1"), lit("a"))) == "1a" and one(refs.case_label(lit("x"), lit("a"))) == "x#a"
    assert one(refs.dotted_parent(lit("a.b.c"))) == "a.b" and one(refs.dotted_parent(lit("a"))) is None
    h = 2166136261
    for b in b"verify":
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    assert one(text.fnv1a(lit("verify"))) == h % 512 and one(text.line_count(lit("a\nb\n"))) == 2 and one(text.line_count(lit(""))) == 0
    assert one(lit("a/b/test_x.py").rlike(text.glob_regex("**/test_*.py"))) and not one(lit("a/test.pyx").rlike(text.glob_regex("**/*.py")))
    with pytest.raises(ValueError):
        filters.parse_predicate("size=>1", {}, {"size": "s"})


def test_deterministic_over_partitions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    a = aggregates.changes_only(e, ["user_id"], ["ts", "event_id"], ["event_type"])
    b = aggregates.changes_only(e.repartition(7), ["user_id"], ["ts", "event_id"], ["event_type"])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_long_routes(spark):
    long = "/".join("abcdefghijklmnopqrst")
    routes = spark.createDataFrame([("GET", f"/{long}/{{id}}"), ("GET", "/{x}/" + long[2:] + "/u"), ("GET", "/" + "/".join(["{p}"] * 40))], "method string, path string")
    calls = spark.createDataFrame([("GET", f"/{long}/7"), ("GET", f"/{long}/u"), ("POST", f"/{long}/7"), ("GET", f"/{long}/7/8"), ("GET", "/" + "/".join("x" * 40))], "method string, path string")
    got = {(r["method"], r["path"]): (r["routes"], r["outcome"]) for r in joins.route_join(calls, routes).collect()}
    assert got == {("GET", f"/{long}/7"): (1, "edge"), ("GET", f"/{long}/u"): (2, "ambiguous"), ("POST", f"/{long}/7"): (0, "no_route"), ("GET", f"/{long}/7/8"): (0, "no_route"), ("GET", "/" + "/".join("x" * 40)): (1, "edge")}


def test_marks_flow_together(spark):
    e = [("r", "a", 15), ("a", "b", 10), ("b", "c", 15), ("t", "c", 15), ("c", "c", 15), ("c", "d", 10), ("x", "y", 15), (None, "z", 15)]
    edges = spark.createDataFrame(e, "src string, dst string, lets int")
    start = spark.createDataFrame([("r", 3), ("t", 12), (None, 3)], "node string, bits int")
    got = {r["node"]: r["bits"] for r in graph.marks(edges, start).collect()}
    assert got == {"r": 3, "t": 12, "a": 3, "b": 2, "c": 14, "d": 10}
    sure, may = edges.where("lets = 15").select("src", "dst"), edges.select("src", "dst")
    nodes = spark.createDataFrame([(n,) for n in "rabctdxyz"], "node string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    got = {r["node"]: r["class"] for r in graph.reach_classes(nodes, sure, may, one("r"), one("t")).collect()}
    assert got == {"r": "entry", "a": "entry", "b": "unknown", "c": "unknown", "d": "unknown", "t": "test_only", "x": "unreached", "y": "unreached", "z": "unreached"}
    assert {r["class"] for r in graph.reach_classes(nodes, sure, may, one("r").where("1 = 0"), one("t")).collect()} == {"unknown"}


def test_rounds_end_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 5)
    line = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string")
    with pytest.raises(RuntimeError):
        graph.closure(line, spark.createDataFrame([("0",)], "node string"))
    assert graph.closure(line, spark.createDataFrame([("0",)], "node string"), 2).count() == 3


def test_mentionable_names(spark):
    names = ["totalFee", "HTTPServer", "total_fee", "MAX_FEE", "plain", "Summary", "_lead", "trail_", "a__b", "1stName", "getId", "GETVALUE", "setState", "aB", "x_y1"]
    got = {r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").where(filters.mentionable(F.col("n"))).collect()}
    assert got == {"totalFee", "HTTPServer", "total_fee", "MAX_FEE", "x_y1"}
