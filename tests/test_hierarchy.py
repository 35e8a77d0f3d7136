import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weftline.operators import hierarchy as H


def brute(parent):
    out = {}
    for k in parent:
        path, at = [k], parent[k]
        seen = {k}
        while at is not None and at not in seen:
            path.append(at)
            seen.add(at)
            at = parent[at]
        if at is None:
            out[k] = (path[-1], len(path) - 1, "/".join(reversed(path)))
        else:
            on = at == k
            out[k] = (None, -1 if on else -2, None)
    return out


def check(spark, parent):
    df = spark.createDataFrame([(k, p, k) for k, p in parent.items()], "k string, parent string, label string")
    got = {r["k"]: r for r in H.hierarchy(df, paths=True, intervals=True).collect()}
    want = brute(parent)
    assert got.keys() == want.keys()
    for k, (root, depth, path) in want.items():
        assert (got[k]["root"], got[k]["depth"], got[k]["path"]) == (root, depth, path)
    for k, (root, depth, path) in want.items():
        if depth >= 0:
            below = {x for x, w in want.items() if w[1] >= 0 and (w[2] + "/").startswith(path + "/")}
            lo, n = got[k]["tree_pre"], got[k]["subtree"]
            assert below == {x for x, w in want.items() if w[0] == root and lo <= got[x]["tree_pre"] < lo + n}


def test_shapes(spark):
    chain = {f"n{i:03}": f"n{i - 1:03}" if i else None for i in range(40)}
    star = {f"s{i}": "s0" if i else None for i in range(30)}
    loops = {"a": "b", "b": "a", "c": "b", "d": "c", "self": "self", "e": "self"}
    check(spark, chain | star | loops)


def test_random_forests(spark):
    rnd = random.Random(3)
    parent = {}
    for i in range(300):
        parent[f"k{i}"] = f"k{rnd.randrange(300)}" if rnd.random() < 0.3 else (f"k{rnd.randrange(i)}" if i and rnd.random() < 0.95 else None)
    check(spark, parent)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1, 11), min_size=1, max_size=12))
def test_any_function(spark, links):
    check(spark, {str(i): (None if p < 0 or p >= len(links) else str(p)) for i, p in enumerate(links)})


def test_empty_and_tables(spark):
    assert H.hierarchy(spark.createDataFrame([], "k string, parent string, label string")).count() == 0
    nodes = spark.createDataFrame(
        [(1, " s ", "a", None, "2025-01-01"), (2, "s", " a", "b", "2025-01-02"), (3, "s", "b", "\t", "2025-01-01"), (3, "s", "b", "\t", "2025-01-01"), (4, "s", None, "a", "2025-01-01"), (5, None, "x", "gone", None), (6, "t", "A", "a", "2025-01-01")],
        "node_no long, source string, id string, parent string, at string",
    ).selectExpr("node_no", "source", "id", "parent", "cast(at as timestamp_ntz) read_at", "1 as depth", "'z' as k")
    edges = spark.createDataFrame([("p ", "c", "contains"), ("c", "p", "part_of"), ("c", "d", "next"), (None, "q", "contains")], "from_id string, to_id string, kind string").selectExpr("*", "cast(null as timestamp_ntz) seen_at")
    got = sorted(tuple(r)[:5] for r in H.unkey(H.hierarchy(H.both_graphs(nodes, edges))).select("graph", "source", "node_id", "root_id", "depth").collect())
    assert got == [("block_edges", "", "c", "p", 1), ("block_edges", "", "p", "p", 0), ("block_edges", "", "q", "q", 0), ("catalogue_nodes", "", "x", "x", 0), ("catalogue_nodes", "s", "a", "b", 1), ("catalogue_nodes", "s", "b", "b", 0), ("catalogue_nodes", "t", "A", "A", 0)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "k string, parent string")
    labels = H.hierarchy(df, intervals=True)
    got = sorted(tuple(r) for r in H.descendants(labels, spark.createDataFrame([("a",), ("b",)], "k string")).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def test_descendants_over_many_buckets(spark):
    parent = {f"{i:04}": None if i == 0 else f"{i - 1:04}" if i < 600 else f"{i % 7:04}" for i in range(1200)}
    labels = H.hierarchy(spark.createDataFrame(list(parent.items()), "k string, parent string"), intervals=True)
    want = set()
    for k in parent:
        up, d = parent[k], 1
        while up is not None:
            want.add((up, k, d))
            up, d = parent[up], d + 1
    got = [tuple(r) for r in H.descendants(labels, labels).collect()]
    assert len(got) == len(want) and set(got) == want


def test_query_lists_descendants(spark, sf):
    from weftline import plans

    q = plans.queries()
    rows = {(r["graph"], r["source"], r["node_id"]): r["n"] for r in q["p2_below"](spark, sf).groupBy("graph", "source", "node_id").agg(F.count("*").alias("n")).collect()}
    want = {(r["graph"], r["source"], r["node_id"]): r["subtree"] - 1 for r in q["p2_descendants"](spark, sf).where("subtree > 1").collect()}
    assert want and rows == want
