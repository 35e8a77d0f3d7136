import random
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.llm import packing as P


def fewest(sizes, cap):
    """Fewest bins, by exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def used(plan):
    out = defaultdict(int)
    for per, times in plan.fillings:
        for s, n in per.items():
            out[s] += n * times
    return out


def test_plans_are_optimal():
    rnd = random.Random(2)
    for i in range(400):
        cap = rnd.randrange(8, 60)
        sizes = [rnd.randrange(1, cap + 1 if i % 2 else cap // 2 + 1) for _ in range(rnd.randrange(1, 13))]
        h = {s: sizes.count(s) for s in sizes}
        got = P.plan(cap, h)
        assert all(sum(s * n for s, n in per.items()) <= cap for per, _ in got.fillings)
        assert used(got) == h and got.bins == sum(t for _, t in got.fillings)
        assert got.bins == fewest(sizes, cap) >= got.least and got.proven
    got = P.plan(20, {2: 1, 5: 3, 6: 1, 7: 1, 9: 3, 10: 1, 12: 1})
    assert got.bins == 4  # where filling the windows one by one, each as well as can be, takes 5


def test_bound_and_dominance():
    assert P.least_windows(10, {6: 3, 5: 1}) == 4 and P.least_windows(10, {}) == 0 and P.least_windows(10, {4: 5}) == 2
    assert P.dominated([(3, 1), (2, 1)], 1, 1 << 6 | 1 << 1) and P.dominated([(3, 1)], 2, 1 << 2) and not P.dominated([(3, 1)], 0, 1 << 3 | 1 << 1)
    assert P.dominated([(2, 2)], 0, 1 << 4) and not P.dominated([(4, 1)], 0, 1 << 2 | 1 << 4)


def test_steps_are_told():
    rnd = random.Random(3)
    h = defaultdict(int)
    for _ in range(60):
        h[rnd.randrange(200, 500)] += 1
    got = P.plan(1000, h, 2000)
    assert used(got) == h and (got.proven or got.steps > 2000 and got.bins - got.least <= 2)


def check(spark, sizes, caps):
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("bin", F.lit("clash"))
    w = spark.createDataFrame(caps, "window_id int, capacity_tokens int").withColumn("doc_id", F.lit(0))
    rows = P.pack(df, w).collect()
    room = dict(caps)
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["window_id"], r["bin"]] += r["tokens"]
        parts[r["window_id"], r["doc_id"]].append((r["part_no"], r["tokens"]))
    assert all(n <= room[k[0]] for k, n in fill.items())
    want = defaultdict(list)
    for d, n in sizes:
        for c, cap in caps:
            if cap and cap > 0:
                want[c, d] += [(i + 1, cap) for i in range(n // cap)] + ([(n // cap + 1, n % cap)] if n % cap else []) if n > cap else [(1, n)]
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    return fill


def test_every_document_once(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([0, 1, 7, 7, 7, 7, 50, 64, 65, 128, 200, rnd.randrange(1, 64)])) for i in range(800)]
    fill = check(spark, sizes, [(1, 64), (2, 100), (3, 0)])
    for w, cap in ((1, 64), (2, 100)):
        used = sum(1 for k, n in fill.items() if k[0] == w and n)
        assert used <= -(-sum(n for _, n in sizes) // cap) * 1.02 + 2
    check(spark, [], [(1, 64)])
    check(spark, [(1, 5), (1, 5)], [(1, 64)])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "a" * 20000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in P.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000 and got[5] > 1 and len(got) == 5


def test_many_short_documents_in_a_window(spark):
    for x in (3, 5, 6, 7):
        per, times = P.plan(8192, {x: 5000}).fillings[0]
        assert per == {x: 8192 // x} and times == 5000 // (8192 // x)
    mixed = {3: 5000, 5: 4000, 7: 9000}
    got = P.plan(8192, mixed)
    assert used(got) == mixed and got.bins == -(-sum(x * n for x, n in mixed.items()) // 8192)
    fill = check(spark, [(i, 7) for i in range(5000)], [(1, 8192)])
    assert sorted(fill.values()) == [320 * 7] + [1170 * 7] * 4


def test_filling_with_many_distinct_lengths():
    left = {x: 1 for x in range(1, 3000)}
    got, _ = P.best_filling(1_000_000, left, P._mask(left))
    assert sum(x * n for x, n in got) == 1_000_000 and len({x for x, _ in got}) == len(got) and all(n == 1 for _, n in got)


def test_usage_and_faults(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 25), (4, 0)], "doc_id long, tokens long")
    w = spark.createDataFrame([(1, 10), (2, None)], "window_id int, capacity_tokens int")
    plans = P.window_plans(sizes, w)
    packed = P.pack(sizes, w, plans)
    assert [tuple(r) for r in P.usage(packed, w, plans).collect()] == [(1, 10, 4, 35, 4, 0.125, 0, True)]
    assert [tuple(r) for r in P.faults(packed, sizes, w).collect()] == [(1, 4, 0, 0, 0)]
    assert [r[2:] for r in P.faults(packed.where("part_no > 1").withColumn("tokens", F.col("tokens") * 3), sizes, w).collect()] == [(2, 1, 0)]
