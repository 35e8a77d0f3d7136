import json

from pyspark.sql import functions as F

from weftline import plans
from weftline.operators import nested as N


def flat(body):
    rows = list(N.triples(body))
    keys = [(c, p, o, v) for c, p, o, path, v in rows if path == ""]
    value = {(c, p, o, path): v for c, p, o, path, v in rows if path}
    return sorted((c, p, o, value.get((c, p, o, "business" if c == "owner" else "id")) or (k or "") if c != "rule" else "") for c, p, o, k in keys)


def test_shapes():
    b = {"Owners": [{"Business": "x"}, {"Engineering": "e"}, None, {"Business": " "}, {"business": "y"}], "capabilities": json.dumps({"c1": {"rules": ["r", None, " ", "s"]}, "c2": None, "c3": {"Rules": "one"}}),
         "Invariants": {"ID": "INV-1", "Statement": "s", "cases": {"b": {"kind": "k"}, "a": {}}}}
    assert flat(json.dumps(b)) == [("capability", 0, 1, "c1"), ("capability", 0, 2, "c3"), ("case", 1, 1, "b"), ("case", 1, 2, "a"), ("invariant", 0, 1, "INV-1"), ("owner", 0, 1, "x"), ("owner", 0, 2, "y"), ("rule", 1, 1, ""), ("rule", 1, 2, ""), ("rule", 2, 1, "")]
    assert flat('{"Owners": "team", "Invariants": [null, {"id": "i", "Cases": {"id": "a", "statement": "x"}}, {}], "Capabilities": null}') == [("case", 1, 1, "a"), ("invariant", 0, 1, "i"), ("invariant", 0, 2, ""), ("owner", 0, 1, "team")]
    for bad in (None, "", "{", "[]", "3", '{"Owners": NaN}'):
        assert flat(bad) == []


def test_ordinals_and_tables(spark):
    df = spark.createDataFrame([(1, '{"Capabilities": [{"ID": "a", "Summary": "s"}, {"ID": "a"}]}'), (1, '{"Capabilities": [{"ID": "a", "Summary": "s"}, {"ID": "a"}]}'), (2, None), (None, "{}")], "manifest_id long, body string").withColumn("id", F.lit("clash"))
    got = sorted(tuple(r) for r in N.manifest_records(df, ["id", "summary"]).select("doc", "child", "parent_ordinal", "ordinal", "f_id", "f_summary").collect())
    assert got == [(1, "capability", 0, 1, "a", "s"), (1, "capability", 0, 2, "a", None)]
    assert N.manifest_records(df.where("1 = 0"), ["id"]).count() == 0


def brute(body):
    try:
        j = json.loads(body)
    except ValueError:
        return []
    get = lambda d, *n: next((v for k, v in d.items() if k.lower() in n and v is not None), None)

    def listed(v, bare=False):
        if isinstance(v, str) and v[:1] in "[{":
            v = json.loads(v)
        if isinstance(v, str):
            v = [v] if bare else []
        if isinstance(v, dict):
            v = [v] if any(k.lower() in ("id", "statement", "summary") for k in v) else [{"id": k} | x for k, x in v.items() if x is not None]
        return [x for x in v or [] if x is not None and (not isinstance(x, str) or x.strip())]

    out = []
    own = get(j, "owners")
    own = [own] if isinstance(own, (str, dict)) else own or []
    n = 0
    for o in own:
        b = o if isinstance(o, str) else get(o, "business") if o else None
        if b and b.strip():
            n += 1
            out.append(("owner", 0, n, b))
    for child, name, sub, subname in (("capability", "capabilities", "rule", "rules"), ("invariant", "invariants", "case", "cases")):
        for i, r in enumerate(listed(get(j, name)), 1):
            out.append((child, 0, i, get(r, "id") or ""))
            for k, s in enumerate(listed(get(r, subname), sub == "rule"), 1):
                out.append((sub, i, k, "" if sub == "rule" else get(s, "id") or ""))
    return out


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/features.parquet").select("manifest_id", "body").distinct().collect()
    want = sorted((r[0], *x) for r in rows for x in brute(r[1]))
    got = sorted(tuple(r) for r in plans.queries()["p5_found"](spark, sf).select("manifest_id", "child", "parent_ordinal", "ordinal", "item").collect())
    assert got == want


def test_very_deep_and_long_values(spark):
    for levels in (1500, 10_000, 20_000):
        nest = '{"a": [' * levels + "1" + "]}" * levels
        deep = f'{{"Owners": "o", "Value": {nest}, "Capabilities": [{{"ID": "c", "Value": {nest}, "Rules": ["r"]}}]}}'
        assert flat(deep) == [("capability", 0, 1, "c"), ("owner", 0, 1, "o"), ("rule", 1, 1, "")]
    long = json.dumps({"Owners": "x" * 300_000})
    got = {r["doc"]: r["f_business"] for r in N.manifest_records(spark.createDataFrame([(1, deep), (2, long)], "manifest_id long, body string"), ["business"]).where("child = 'owner'").collect()}
    assert got == {1: "o", 2: "x" * 300_000}


def test_stream_of_triples():
    kinds = {N.OBJECT: "{", N.LIST: "["}
    got = [(N._path(s, m), kinds.get(v, v)) for s, m, v in N.stream('{"A": {"b_c": [1, [true, {"d": null}]], "e": {}}, "f": [[[[[["x"]]]]]]}')]
    assert got == [("", "{"), ("a", "{"), ("a.bc", "["), ("a.bc[1]", 1), ("a.bc[2]", "["), ("a.bc[2][1]", True), ("a.bc[2][2]", "{"), ("a.bc[2][2].d", None), ("a.e", "{"), ("f", "["), ("f[1]", "["), ("f[1][1]", "["), ("f[1][1][1]", "["), ("f[1][1][1][1]", "["), ("f[1][1][1][1][1]", "["), ("f[1][1][1][1][1][1]", "x")]


def test_flat_tables(spark):
    body = {"ID": "f", "Owners": {"Business": "b", "OnCall": "n"}, "Capabilities": {"c1": {"Summary": "s", "Rules": ["r1", None, "r2"], "CounterExamples": "only"}, "c2": {}},
            "Invariants": [{"ID": "INV-1", "VerifiableBy": ["test", "review"], "cases": [{"id": "a", "retired": True, "enforcer": {"x": 1}}, {}]}], "DependsOn": ["x.y"], "Value": {"n": 1}}
    df = spark.createDataFrame([(1, json.dumps(body)), (1, json.dumps(body)), (2, "{"), (None, "{}")], "manifest_id long, body string").withColumn("ordinal", F.lit("clash"))
    rows = lambda t: sorted(tuple(r) for r in N.manifest_table(df, t).collect())
    assert rows("owners") == [(1, 1, "b", None, "n")] and rows("capabilities") == [(1, 1, "c1", None, "s"), (1, 2, "c2", None, None)]
    assert rows("rules") == [(1, 1, 1, "r1"), (1, 1, 2, "r2")] and rows("counter_examples") == [(1, 1, 1, "only")]
    assert rows("invariants") == [(1, 1, "INV-1", None)] and rows("verifiable_by") == [(1, 1, 1, "test"), (1, 1, 2, "review")]
    assert rows("cases") == [(1, 1, 1, "a", None, None, None, "true"), (1, 1, 2, None, None, None, None, None)] and rows("depends_on") == [(1, 1, "x.y")]
    assert {r[0] for t in N.TABLES for r in rows(t)} == {1}
    assert N.manifest_table(df.where("1 = 0"), "cases").count() == 0
