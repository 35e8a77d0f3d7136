import random

from pyspark.sql import functions as F

from weftline.llm import leakage as L

WORDS = [a + b for a in ("mar", "kel", "dov", "sin", "tur", "bel", "gor", "vin") for b in ("tan", "rik", "mol", "sed", "pag", "lun", "cof")]


def passage(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    return sorted((r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect())


def test_noise_does_not_hide_a_leak(spark):
    rnd = random.Random(1)
    p, q = passage(rnd, 60), passage(rnd, 90)
    w = p.split()
    altered = " ".join("other" if i % 9 == 4 else x for i, x in enumerate(w))
    broken = " ".join(x[:2] + "-\n> " + x[2:] if i % 6 == 0 else x for i, x in enumerate(w))
    docs = [
        (1, "Some words. " + p.upper() + "! More."), (2, "\n".join("> **" + x + "**," for x in w)), (3, altered), (4, broken), (5, "<p>" + " <i>".join(w) + "</i>"), (6, "​".join(p)),
        (7, " ".join(w[:12])), (8, " ".join(w[:16]) + " zzz " + passage(random.Random(9), 30)), (9, " ".join(w[:18]) + " and so on and then came the rest " + " ".join(w[30:50])), (10, " ".join("other" if i % 4 == 0 else x for i, x in enumerate(w))),
        (11, None), (12, ""), (13, " ".join(w[40:]) + " x y z a b c d e " + " ".join(w[:20])), (14, p.replace(" ", "  \n")), (14, p), (None, p), (15, "".join(w)), (16, q[: len(q) // 5]),
    ]
    items = [(1, p), (2, q), (3, None), (4, "too short to count"), (None, p), (1, p)]
    assert found(spark, docs, items) == [(i, 1) for i in (1, 2, 3, 4, 5, 6, 9, 13, 14, 15)]


def test_shared_passages_and_empty_tables(spark):
    p = passage(random.Random(3), 40)
    assert found(spark, [(1, p)], [(1, p), (2, p), (3, p + " " + passage(random.Random(4), 20))]) == [(1, 1), (1, 2), (1, 3)]
    assert found(spark, [(1, p)], []) == [] and found(spark, [], [(1, p)]) == []


def test_prefix_filter_loses_nothing(spark):
    """Against verifying all pairs."""
    rnd = random.Random(8)
    items = [(i, passage(rnd, rnd.randrange(20, 80))) for i in range(12)]
    docs = []
    for d in range(120):
        w = rnd.choice(items)[1].split()
        a = rnd.randrange(len(w) - 15)
        part = w[a : a + rnd.randrange(15, 60)]
        part = ["other" if rnd.random() < rnd.choice([0, 0.05, 0.12, 0.2]) else x for x in part if rnd.random() > 0.03]
        docs.append((d, passage(rnd, 10) + " " + " ".join(part) + " " + passage(rnd, 10)))
    words = {i: L.words_of(t) for i, t in items}
    want = sorted((d, i) for d, t in docs for i in words if L.holds(words[i], L.words_of(t)) >= L.needed(len(words[i])))
    assert found(spark, docs, items) == want and len(want) > 20


def test_items_in_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(i, passage(rnd, 40)) for i in range(9)]
    docs = [(i, t) for i, t in items]
    monkeypatch.setattr(L, "BLOCK_LETTERS", 500)
    assert found(spark, docs, items) == [(i, i) for i in range(9)]


def test_least_shared_is_a_lower_bound():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(20, 70)
        w = [f"w{i}" for i in range(n)]
        hit = set(rnd.sample(range(n), n // L.ONE_IN))
        doc = [x for i, x in enumerate(w) if i not in hit]
        doc_shingles = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        shared = sum(tuple(w[i : i + 5]) in doc_shingles for i in range(n - 4))
        assert shared >= L.least_shared(20)


def planted(rnd, item, edges):
    """A document with stretches of 15 to 24 words that hold just enough of the item, each with one
    word in eight altered or left out, in any order, and how many words they hold."""
    need, parts, total, at = L.needed(len(item)), [], 0, 0
    while total < need and at + 15 <= len(item):
        n = min(rnd.randrange(15, 25), len(item) - at)
        hit = set(rnd.sample(range(n) if edges else range(1, n - 1), n // L.ONE_IN))
        parts.append([f"zq{rnd.randrange(99)}" if j in hit else w for j, w in enumerate(item[at : at + n]) if j not in hit or rnd.random() < 0.6])
        total, at = total + n, at + n + rnd.randrange(3)
    rnd.shuffle(parts)
    return [w for p in parts for w in passage(rnd, rnd.randrange(1, 40)).split() + p] + passage(rnd, 5).split(), total


def test_recall_of_altered_stretches():
    """Stretches as short and altered as they may be; words also come elsewhere in the document."""
    rnd, tried, lost = random.Random(12), 0, 0
    for _ in range(1500):
        item = passage(rnd, rnd.randrange(40, 140)).split()
        doc, total = planted(rnd, item, False)
        if total >= L.needed(len(item)):
            tried += 1
            lost += L.holds(item, doc) < L.needed(len(item))
    assert tried > 1000 and lost <= tried // 1000


def test_items_hold_themselves():
    for phrase in (1, 2, 5, 6, 7):
        item = [f"w{i}" for i in range(phrase)] * 40
        assert L.holds(item, item) == len(item)
        assert L.holds(item, item[: len(item) // 2] + ["x"] * 9 + item[len(item) // 2 :]) >= len(item) // 2
    rnd = random.Random(4)
    item = passage(rnd, 300).split()
    doc = [w for k in range(60) for w in passage(rnd, 8).split() + item[k * 5 : k * 5 + 5]]
    assert L.holds(item, doc) == 0  # sixty quotes of five words
    assert L.holds(item, doc + item[:120]) == 120


def test_long_tags_and_run_together_words(spark):
    p = passage(random.Random(3), 40)
    w = p.split()
    docs = [(1, " ".join(f'<a href="{"x" * 400}">{x}</a>' for x in w)), (2, "".join(w)), (3, " ".join(x[:2] + " " + x[2:] if i % 5 == 0 else x for i, x in enumerate(w)))]
    assert found(spark, docs, [(1, p)]) == [(1, 1), (2, 1), (3, 1)]


def test_in_place():
    assert L.in_place([(0, 1), (10, 2), (100, 3), (300, 4)], 20) == {1, 2} and L.in_place([], 5) == set()


def test_word_counts_with_and_without_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "One two two."), (2, "TWO three"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two four"), (2, "one two")], "item_id long, words string")
    for most in (200_000, 1):
        monkeypatch.setattr(L, "MOST_WORDS", most)
        assert {r["w"]: r["n"] for r in L._word_counts(texts, items).collect()} == {"one": 1, "two": 2}
