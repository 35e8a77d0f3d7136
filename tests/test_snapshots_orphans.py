import random

from pyspark.sql import functions as F

from weftline.functions import scale
from weftline.operators import orphans as O
from weftline.operators import snapshots as S

AUDIT = "snapshot_no int, delivery int, promise string, class string, signals struct<demonstrated: struct<value: string, honesty: string, detail: string>>, loaded_at timestamp_ntz"


def audit(spark, rows):
    return spark.createDataFrame([(s, d, p, c, None if v is None else ((None if v == "-" else (v, None, None)),), None) for s, d, p, c, v in rows], AUDIT).withColumn("change", F.lit("clash"))


def test_promise_changes(spark):
    rows = [
        (1, 1, "A:INV-1", "fake", None), (1, 1, "a :inv-1", "fake", None), (1, 1, None, "fake", "yes"), (1, 1, " ", "fake", "yes"), (1, 1, "b", "x-y", "Yes"), (1, 1, "c", None, ""),
        (3, 1, "a:inv-1", "unknown", None), (3, 2, "a:inv-1", " FAKE", "-"), (3, 2, "b", "X y ", " yes"), (3, 2, "d", "q", "no"), (None, 1, "e", "q", "no"),
        (4, 1, "a:inv-1", "fake", "unknown"), (4, 1, "d", "q", "no"), (4, 1, "c", "", None),
    ]
    got = sorted(tuple(r)[:3] for r in S.promise_changes(audit(spark, rows)).select("snapshot_no", "promise", "change").collect())
    assert got == [(3, "c", "removed"), (3, "d", "added"), (4, "a:inv-1", "changed"), (4, "b", "removed"), (4, "c", "added")]
    assert S.promise_changes(audit(spark, [])).count() == 0


def test_changes_match_brute_force(spark):
    rnd = random.Random(1)
    rows = list({(k, s): (f"k{k}", s, rnd.choice("ab")) for k in range(40) for s in (1, 2, 5, 9) if rnd.random() < 0.7}.values())
    df = spark.createDataFrame(rows, "key string, snap int, v string")
    got = {(r["snap"], r["key"], r["change"]) for r in S.snapshot_changes(df, S.present_snapshots(df, "snap"), "snap", "key", ["v"]).collect()}
    at = {s: {k: v for k, t, v in rows if t == s} for s in (1, 2, 5, 9)}
    want = set()
    for a, b in ((1, 2), (2, 5), (5, 9)):
        want |= {(b, k, "added") for k in at[b].keys() - at[a].keys()} | {(b, k, "removed") for k in at[a].keys() - at[b].keys()} | {(b, k, "changed") for k in at[a].keys() & at[b].keys() if at[a][k] != at[b][k]}
    assert got == want


def lives(spark, rows):
    return spark.createDataFrame(rows, "key string, a string, b string").selectExpr("key", "cast(a as timestamp_ntz) a", "cast(b as timestamp_ntz) b")


def test_runs_are_compressed(spark):
    d = lives(spark, [("x", "2025-01-01", "2025-01-05"), ("x", "2025-01-05", "2025-01-09"), ("x", "2025-01-02", "2025-01-03"), ("x", "2025-02-01", None), ("x", "2025-02-01", None), ("y", None, None)])
    got = sorted((r["key"], str(r["_from"]), str(r["_to"])) for r in O.life_runs(d, ["key"], "a", "b").collect())
    assert got == [("x", "2025-01-01 00:00:00", "2025-01-09 00:00:00"), ("x", "2025-02-01 00:00:00", "9999-12-31 00:00:00"), ("y", "None", "9999-12-31 00:00:00")]


def test_keys_are_split(spark):
    keys = ["f:INV-12", "a007", "a0", "x", "", "9" * 30, "-5", "n\n12", "a.b()"]
    got = {r["k"]: (r["_stem"], r["_n"]) for r in O.split_key(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {"f:INV-12": ("f:INV-", 12), "a007": ("a00", 7), "a0": ("a", 0), "x": ("x", -1), "": ("", -1), "9" * 30: ("9" * 12, int("9" * 18)), "-5": ("-", 5), "n\n12": ("n\n", 12), "a.b()": ("a.b()", -1)}


def test_keys_are_compressed_into_runs(spark):
    d = spark.createDataFrame([("f", n) for n in (1, 2, 2, 3, 7, 9, 10, 510, 511, 512, 513, -1)], "s string, _n long").withColumn("_b", F.floor(F.col("_n") / O.BUCKET))
    got = sorted((r["_n"], r["_last"]) for r in O.key_runs(d, ["s"]).collect())
    assert got == [(-1, -1), (1, 3), (7, 7), (9, 10), (510, 511), (512, 513)]


def test_states_with_and_without_salt(spark, monkeypatch):
    rnd = random.Random(4)
    day = lambda n: f"2025-01-{n:02}"
    own = [(f"k{rnd.choice([1, 2, 3, 7, 511, 512, 600])}", a := rnd.randrange(1, 15), rnd.choice([None, a + rnd.randrange(0, 8)])) for _ in range(14)] + [("plain", 3, 9), (None, 1, 2)]
    refs = [(i, rnd.choice(["k1", "k1", "k1", "k2", "k4", "k7", "k8", "k511", "k512", "k513", "k01", "none", "plain", None]), rnd.choice([None, *range(1, 25)])) for i in range(600)]
    parents = lives(spark, [(k, day(a), b and day(b)) for k, a, b in own])
    r = spark.createDataFrame([(i, k, n and day(n)) for i, k, n in refs], "row long, key string, at string").selectExpr("row", "key", "cast(at as timestamp_ntz) at")
    want = set()
    for i, k, n in refs:
        mine = [(a, b) for x, a, b in own if x == k]
        if k and not (n and any(a <= n and (b is None or b > n) for a, b in mine)):
            want.add((i, "missing" if not mine else "late" if n and any(a > n for a, _ in mine) else "deleted"))
    found = lambda: {(x["row"], x["state"]) for x in O.orphans(r, parents, [], "key", "at", ["row"], "a", "b").collect()}
    plain = found()
    monkeypatch.setattr(O, "salted", lambda b, s, k, sp: scale.salted(b, s, k, sp, least=20))
    assert plain == want and found() == want and {s for _, s in want} == {"missing", "late", "deleted"}


def test_references(spark):
    rtm = spark.createDataFrame(
        [(1, " a:INV-1#x , INV-2,, ", "f", " INV-3 ", ["m.f() ", None, "", "m.f"], None), (2, None, None, None, [], ["t()#q"]), (1, " a:INV-1#x , INV-2,, ", "f", " INV-3 ", ["m.f() ", None, "", "m.f"], None)],
        "row_id long, maps_to string, feature_id string, invariant_id string, enforcers array<string>, verifiers array<string>",
    ).selectExpr("*", "timestamp_ntz'2025-03-01' recorded_at", "'z' state", "1 target")
    got = sorted((r["row_id"], r["field"], r["target"], r["ref_key"]) for r in O.rtm_references(rtm).distinct().collect())
    assert got == [(1, "enforcers", "code", "m.f"), (1, "invariant_id", "invariant", "f:INV-3"), (1, "maps_to", "invariant", "a:INV-1"), (1, "maps_to", "invariant", "f:INV-2"), (2, "verifiers", "test", "t")]
    inv = spark.createDataFrame([], "feature string, inv string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    sym = spark.createDataFrame([], "fqn string, is_test boolean, created_at timestamp_ntz, deleted_at timestamp_ntz")
    assert {r["state"] for r in O.rtm_orphans(rtm, inv, sym).collect()} == {"missing"}
    assert O.rtm_orphans(rtm.where("1 = 0"), inv, sym).count() == 0


def test_checked_broadcast(spark):
    df = spark.range(10)
    assert scale.small_or_none(df, 9) is None and len(scale.small_or_none(df, 10)) == 10
    assert scale.checked_broadcast(df, 9) is df


def test_cut_tables_are_counted_and_swept(spark):
    import os

    t = scale.cut(spark.range(10), None, n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert scale.seen(t, "n") == 10 and scale.seen(t, "odd") == 5 and scale.seen(scale.cut(spark.range(0), None, n=F.count(F.lit(1))), "n") == 0
    u = scale.cut(t.where("id > 3"), t)
    at = t._weftline_path.removeprefix("file:")
    assert not os.path.exists(at) and u.count() == 6
    assert scale.sweep(spark) >= 2 and not os.path.exists(u._weftline_path.removeprefix("file:")) and scale.sweep(spark) == 0
