import random

from pyspark.sql import functions as F

from weftline.llm import truncation as T

SENTENCES = ["The settlement worker keeps the first answer for seven pages.", "Every edge from the ledger is declared, none of them is wired.", "We measured four hours on a quiet day and nine during the night.", "Whoever renames the symbol has to move the annotation along with it.", "The nightly report lists every basket with its owner and the last change."]


def corpus(rnd, n, start=0, source="s"):
    return [(start + i, " ".join(rnd.choice(SENTENCES) for _ in range(rnd.randrange(2, 7))), source) for i in range(n)]


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("share", F.lit("clash"))
    return {r["doc_id"]: r for r in T.truncated(df).collect()}


def test_cut_and_whole(spark):
    rnd = random.Random(1)
    rows = corpus(rnd, 300)
    tail = "The nightly report lists every basket with its owner and the last change"
    whole = [(1001, "We will see…", "s"), (1002, None, "s"), (1003, "", "s"), (1004, "  ", None), (1005, tail + ".  \n", None)]
    whole += [(1100 + i, SENTENCES[i % 5] + "\n\nOwners:\n- payments\n- growth", "s") for i in range(12)] + [(1200 + i, SENTENCES[0] + "\n\nWe will see…", "s") for i in range(12)]
    cut = [(2000, SENTENCES[0] + " The nightly report lists every bas", "s"), (2001, SENTENCES[1] + " Every edge from the", "s"), (2002, SENTENCES[2] + " Whoever renames the symbol has to move the annot…", "s"), (2003, "```\ndef f():\n    return 1\n", "s"), (2004, SENTENCES[3] + " Every edge from the ledger is decl [...]", "s"), (2005, "The settlement worker keeps the caf�", "s"), (2006, tail, "s")]
    got = found(spark, rows + whole + cut + cut[:1])
    assert got.keys() - {2002} == {2000, 2001, 2003, 2004, 2005, 2006}


def test_limits_are_found(spark):
    rnd = random.Random(2)
    rows = corpus(rnd, 200)
    limited = []
    for i, (_, text, _) in enumerate(corpus(rnd, 200, source="capped")):
        full = text + " " + " ".join(SENTENCES)
        limited.append((1000 + i, full[:300] if len(full) > 300 else full, "capped"))
    got = found(spark, rows + limited)
    want = {d for d, t, _ in limited if len(t) == 300 and not t.rstrip().endswith(".")}
    assert got.keys() == want and all(got[d]["at_limit"] for d in want)
    shares = {r["source"]: r["cut_share"] for r in T.source_shares(spark.createDataFrame(rows + limited, "doc_id long, text string, source string"), T.truncated(spark.createDataFrame(rows + limited, "doc_id long, text string, source string"))).collect()}
    assert shares["s"] == 0.0 and shares["capped"] == int(len(want) / 200 * 10000 + 0.5) / 10000


def test_empty(spark):
    assert found(spark, []) == {}


def test_statistics_match_a_plain_count(spark):
    rows = corpus(random.Random(3), 40) + [(99, "One two three one two", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    import numpy as np

    every = np.full(T.LEAST_BITS // 8, 255, dtype=np.uint8)
    got = {(r["k"], r["ctx"], r["word"]): (r["stops"], r["ends"], r["goes"]) for r in T.corpus_stats(df, every).collect()}
    want = {}
    for _, text, _ in rows:
        x = T.tokens_of(T.without_mark(text)[0])
        for i, w in enumerate(x):
            flag = 1 if i + 1 == len(x) else 0 if x[i + 1] in T._STOPS else 2
            for k in (0, *T.CONTEXTS):
                if i >= k:
                    at = want.setdefault((k, T.context_hash(x[i - k : i]), w), [0, 0, 0])
                    at[flag] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_filter_knows_its_contexts(spark):
    import numpy as np

    rows = spark.createDataFrame([(k, c) for k in T.CONTEXTS for c in (0, -5, 2**62, 12345)], "k int, ctx long")
    bits = T._filter(rows)
    for k in T.CONTEXTS:
        slots = T._spark_filter_slots(k, np.array([0, -5, 2**62, 12345], dtype=np.int64), 8 * len(bits))
        assert all((bits[s >> 3] >> (s & 7)) & 1 for s in slots)
    assert np.unpackbits(bits).sum() <= 16


def test_copies_do_not_vouch_for_each_other(spark):
    rows = corpus(random.Random(1), 300)
    text = SENTENCES[2] + " The nightly report lists every bas"
    tail = SENTENCES[1] + " " + SENTENCES[4].rstrip(".")
    for copies in (1, 6, 1000):
        cut = [(2000 + i, text + " " * (i % 2), "s") for i in range(copies)] + [(5000 + i, tail, "st"[i % 2]) for i in range(copies)]
        assert found(spark, rows + cut).keys() == {r[0] for r in cut}


def test_copies_are_no_limit(spark):
    texts = [(i, "x" * (10 + i) + ".", "s") for i in range(50)]
    copies = [(100 + i, "y" * 80 + ".", "s") for i in range(40)]
    limit = lambda rows: T.limits(T.tails(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()[0]["limit_chars"]
    assert limit(texts + copies) == []
    assert limit(texts + [(100 + i, f"{i:02}" + "y" * 78 + ".", "s") for i in range(40)]) == [81]


def test_several_limits_of_a_source(spark):
    rnd = random.Random(5)
    texts = [(i, "x" * rnd.randrange(20, 1500) + ".", "s") for i in range(600)]
    piles = [(1000 + i, f"{i:03}" + "y" * 497, "s") for i in range(60)] + [(2000 + i, f"{i:03}" + "z" * 1197, "s") for i in range(60)]
    got = T.limits(T.tails(spark.createDataFrame(texts + piles + [(3000, "a" * 3000, "s"), (3001, None, "t")], "doc_id long, text string, source string"))).collect()
    assert len(got) == 1 and got[0]["limit_chars"] == [500, 1200] and got[0]["limit_bytes"] == []
    only = T.limits(T.tails(spark.createDataFrame([r for r in piles[:60]] + [(9, "b" * 900, "s")], "doc_id long, text string, source string"))).collect()
    assert only[0]["limit_chars"] == [500]
    capped = [(i, ("é" * (i % 40) + f"{i:03}" + "y" * 500).encode()[:300].decode(errors="ignore"), "s") for i in range(80)]
    last = T.limits(T.tails(spark.createDataFrame(capped, "doc_id long, text string, source string"))).collect()[0]
    assert last["limit_bytes"] == [300] and last["limit_chars"] == []


def test_words_cut_behind_many_letters(spark):
    """An unknown beginning of known words, however long; a known word and an unknown one that begins none are no such."""
    word = "Abschlagsrechnungsbearbeitungsstellenleitung"
    rows = corpus(random.Random(1), 100) + [(500 + i, f"{SENTENCES[i % 5]} The {word} answers. {SENTENCES[0]}", "s") for i in range(8)]
    cut = [(2000, f"{SENTENCES[0]} The {word[:38]}", "s"), (2001, f"{SENTENCES[0]} The {word[:20]}", "s"), (2002, f"{SENTENCES[0]} {word[:36]}", "s")]
    got = found(spark, rows + cut + [(3000, SENTENCES[0] + " qqzzkk", "s"), (3001, "z" * 50_000, "s")])
    assert {d: r["evidence"] for d, r in got.items() if d < 3000} == {2000: "word", 2001: "word", 2002: "word"}
    counts = {(r["source"], r["evidence"]): r["cut_texts"] for r in T.evidence_counts(T.truncated(spark.createDataFrame(rows + cut, "doc_id long, text string, source string"))).collect()}
    assert counts == {("s", "word"): 3}


def test_trie_counts_prefixes(spark):
    stats = spark.createDataFrame([(0, 0, w, 1, 0, 2) for w in ("car", "care", "careful", "x" * 40, "x" * 41, "x" * 45)], "k int, ctx long, word string, stops long, ends long, goes long")
    asked = spark.createDataFrame([(0, 0, w) for w in ("car", "ca", "careful", "dog", "x" * 40, "x" * 35, "x" * 45)], "k int, ctx long, last string")
    got = {r["last"]: (r["stops"] + r["goes"], r["longer"]) for r in T.trie(stats, asked).collect()}
    assert got == {"car": (3, 6), "ca": (0, 9), "careful": (3, 0), "x" * 40: (3, 6), "x" * 35: (0, 9), "x" * 45: (3, 0)}
