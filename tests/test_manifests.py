import json

from pyspark.sql import functions as F

from weftline import plans
from weftline.operators import manifests as M


def between(a, b):
    return sorted(M.differences(*(json.loads(M.canonical(json.dumps(x))) for x in (a, b))))


def test_paths():
    a = {"ID": "f", "Owners": {"Business": "x"}, "Invariants": [{"ID": "INV-1", "Statement": "s", "cases": [{"id": "a", "kind": "k"}]}, {"ID": "INV-2"}], "Capabilities": [{"id": "c", "rules": ["r", "t"]}], "DependsOn": ["p"]}
    b = {"id": "f", "owners": [{"business": "y"}], "invariants": [{"id": "INV-3"}, {"id": "INV-1", "statement": "S", "cases": {"a": {"kind": "l"}}}], "capabilities": {"c": {"Rules": "r"}}, "value": {"customer": "v"}, "depends_on": []}
    assert between(a, b) == [
        ("capabilities[c].rules", "changed", '[{"text": "r"}, {"text": "t"}]', '[{"text": "r"}]'), ("dependson", "removed", '["p"]', None), ("invariants[INV-1].cases[a].kind", "changed", "k", "l"),
        ("invariants[INV-1].statement", "changed", "s", "S"), ("invariants[INV-2]", "removed", '{"id": "INV-2"}', None), ("invariants[INV-3]", "added", None, '{"id": "INV-3"}'), ("owners.business", "changed", "x", "y"), ("value", "added", None, '{"customer": "v"}'),
    ]
    assert between({"Invariants": [{"ID": "i"}, {"ID": "i"}]}, {"Invariants": []}) == [("invariants", "removed", '[{"id": "i"}, {"id": "i"}]', None)]
    assert between(a, a) == between({"x": None, "y": []}, {}) == []
    assert between({"x": [1]}, {"x": [True]}) == [("x", "changed", "[1]", "[true]")]


def test_every_version_is_compared_with_the_next(spark):
    body = lambda s: json.dumps({"Invariants": [{"ID": "INV-1", "Statement": s}]})
    rows = [(1, "f", 1, "draft", "p", 1, body("one")), (2, "f", 2, "final", "p", 2, body("two")), (2, "f", 2, "final", "p", 2, body("two")), (3, "f", 2, "final", "p", 3, "{"), (4, "f", 2, "final", "p", 4, body("three")), (5, "f", 3, "draft", "p", 5, body("one")), (6, "g", None, None, "p", 1, body("x")), (7, "g", 1, None, "q", 0, body("y")), (8, None, 1, "s", "p", 1, body("z"))]
    df = spark.createDataFrame(rows, "manifest_id long, feature_id string, version int, status string, source_path string, at int, body string").select("*", F.timestamp_seconds("at").cast("timestamp_ntz").alias("loaded_at"), F.lit("clash").alias("field"))
    at = "invariants[INV-1].statement"
    want = {("f", 1, 2, 1, 2, at, "changed", "one", "two"), ("f", 2, 2, 2, 4, at, "changed", "two", "three"), ("f", 2, 3, 4, 5, at, "changed", "three", "one"), ("f", 1, 2, 1, 2, "row.status", "changed", "draft", "final"), ("f", 2, 3, 4, 5, "row.status", "changed", "final", "draft"), ("f", None, 2, None, 3, "", "unreadable", None, None), ("g", None, 1, 6, 7, at, "changed", "x", "y"), ("g", None, 1, 6, 7, "row.source_path", "changed", "p", "q")}
    got = [tuple(r) for r in M.manifest_changes(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert M.manifest_changes(df.where("1 = 0")).count() == 0


def test_query_gives_the_changes_of_a_plain_walk(spark, sf):
    rows = {tuple(r) for r in spark.read.parquet(f"{sf}/features.parquet").where("feature_id IS NOT NULL").select("feature_id", "version", "loaded_at", "manifest_id", "body").collect()}
    want, last = [], {}
    for f, v, _, m, body in sorted(rows, key=lambda r: (r[0], *((x is not None, x or 0) if i != 1 else (x is not None, x) if x else (False, "") for i, x in enumerate(r[1:4])), M.canonical(r[4]) or "")):
        form = M.canonical(body)
        if form is not None:
            if f in last:
                want += [(f, last[f][0], v, last[f][1], m, *d) for d in M.differences(json.loads(last[f][2]), json.loads(form))]
            last[f] = (v, m, form)
    got = [tuple(r) for r in plans.queries()["d3_manifest_changes"](spark, sf).where("field NOT LIKE 'row.%' AND field <> ''").collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))
