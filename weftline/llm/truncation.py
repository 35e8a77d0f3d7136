"""Text cut off by field limits (problem 8).

All words of the corpus form a trie kept as a table of nodes. A text whose last token is no known
word but the proper beginning of known ones was cut within a word (evidence ``word``). For texts
that end in a known word the same trie stands behind each context of one to four words: where the
corpus almost always goes on, the text was cut between words (evidence ``context``). Length adds
its evidence to both: sources with a field limit show many texts of one length. Open code blocks,
broken letters and marks of a cut tell by themselves.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scale import checked_broadcast, cut, salted

#: Words before the last token that make a context.
CONTEXTS = (1, 2, 3, 4)
#: The filter of wanted contexts has so many bits for each of them, a power of two between the bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Occurrences that make a context count; below it the next shorter one decides.
SUPPORT = 4
#: A text is cut if the corpus stops there in less than this share of cases, by length evidence.
SHARE, SHARE_AT_LIMIT, SHARE_MARKED = 0.5, 0.9, 0.05
#: Other texts that end the same way, and how many per occurrence that goes on, make an ending
#: usual. Cuts fall anywhere, so they repeat one and the same place far less often.
USUAL_TEXTS, USUAL_RATIO = 5, 0.1
#: A length is a limit of a source if this many of its texts, and this share of them, have it, and so
#: many times more than other lengths within so many characters have on average.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_PEAK, LIMIT_NEAR = 3, 0.02, 5, 50
#: A cut between words, or one that left a mark, ends at most this far before the limit.
SLACK = 24

_TOKEN = re.compile(r"\n+|[^\W\d_]+(?:['’_-][^\W\d_]+)*|\d+|```|[^\w\s]|_")
_MARK = re.compile(r"\s*(\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|\.{3,}|<(?:truncated|cut|more)>|\[(?:truncated|cut|more)\])\s*$", re.I)
#: What may follow the last word of a whole text: a line's end. Before a full stop a text goes on,
#: for it would have kept that; endings that are usual without one are told by the texts that have them.
_STOPS = frozenset("\n")
_SEED = np.uint64(0x9E3779B97F4A7C15)

TAILS = "doc_id long, copy long, source string, chars long, bytes long, mark string, ending string, k int, ctx long, last string"
#: White space that does not make a copy another text.
BLANKS = " \t\n\r\x0b\x0c"
STATS = "k int, ctx long, word string, stops long, ends long, goes long"


def tokens_of(text: str) -> list[str]:
    """Words, numbers as `0`, line ends as one token, other signs one by one."""
    return ["\n" if t[0] == "\n" else "0" if t.isdigit() else t for t in _TOKEN.findall(text)]


def without_mark(text: str) -> tuple[str, str]:
    """The text without outer white space and the mark a cut may have left, and the mark."""
    text = text.rstrip()
    m = _MARK.search(text[-64:])
    return (text[: len(text) - len(text[-64:]) + m.start()].rstrip(), m[1]) if m else (text, "")


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(words))


def context_hash(words: list[str]) -> int:
    """A signed 64-bit number for a context, equal to the vectorised one of :func:`_stat_rows`."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _SEED + np.uint64(_hash([w]))
    return int(h.astype(np.int64))


def _tail_rows(ids, texts, sources, copies):
    for doc, text, source, copy in zip(ids, texts, sources, copies):
        if not text or not text.strip():
            continue
        core, mark = without_mark(text)
        size = len(text), len(text.encode("utf-8", "replace"))
        ending = "fence" if core.count("```") % 2 else "lost" if core.endswith("�") else "stop" if core[-1:] in (".", "?", "!") else "open"
        x = tokens_of(core[-2000:]) if ending == "open" else [core[-1:]]
        if not x:
            continue
        # A whole ending needs no context; its row is there for the sources' limits and shares.
        if ending == "open":
            for k in (0, *CONTEXTS):
                if len(x) > k:
                    yield doc, copy, source, *size, mark, ending, k, context_hash(x[len(x) - 1 - k : -1]), x[-1]
        else:
            yield doc, copy, source, *size, mark, ending, -1, 0, x[-1]


def tails(documents: DataFrame) -> DataFrame:
    """The last token of each text with its contexts, one row per context (``k`` words); one row
    with ``k`` -1 for texts that end in a full stop or an open code block. Null and blank texts give
    none. ``copy``: a hash of the text, by which its copies are known."""

    def run(batches):
        for b in batches:
            rows = list(_tail_rows(*(b.column(i).to_pylist() for i in range(4))))
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in TAILS.split(", ")])

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("copy"))
    return rows.mapInArrow(run, TAILS)


def _filter(open_tails: DataFrame) -> np.ndarray:
    """A bit per hash value of the wanted contexts, gathered in slices of 4 KB. Its size follows the
    number of contexts up to a bound of 128 MB; a fuller filter lets more through, and loses none."""
    wanted = open_tails.where("k > 0")
    n = wanted.agg(F.approx_count_distinct(F.xxhash64("k", "ctx"))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    at = F.pmod(F.xxhash64("k", "ctx"), F.lit(bits))
    slices = wanted.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("slice")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in slices.collect():  # at most MOST_BITS / 32768 rows
        out[r["slice"] * 4096 : (r["slice"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _spark_filter_slots(k: int, ctx: np.ndarray, size: int) -> np.ndarray:
    """The places of contexts in a filter of ``size`` bits: Spark's ``xxhash64(k, ctx)``, seed 42, chained over both columns."""
    with np.errstate(over="ignore"):
        first = np.uint64(xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), seed=42))
        p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
        rot = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
        h = np.full(len(ctx), first + p5 + np.uint64(8), dtype=np.uint64)
        h ^= rot(ctx.astype(np.uint64) * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h.astype(np.int64) % size


def corpus_stats(documents: DataFrame, wanted: np.ndarray) -> DataFrame:
    """How often each word stands, stops and goes on, in the wanted contexts and without one:
    ``k, ctx, word, stops, ends, goes`` (before a stop, at the end of a text, before more), counted over all distinct texts (copies count once, white space at the end aside) and aggregated per batch before the shuffle."""
    held = documents.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches):
        bits = np.frombuffer(held.value, dtype=np.uint8)
        raw: defaultdict[str, int] = defaultdict()
        raw.default_factory = raw.__len__
        seen, names = [], {}
        canon, hashes, stopping = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        for b in batches:
            at: list[int] = []
            line = []
            for text in b.column(0).to_pylist():
                n = len(at)
                at.extend(map(raw.__getitem__, _TOKEN.findall(without_mark(text)[0])))
                if len(at) > n:
                    line.append(len(at) - n)
            if not at:
                continue
            # Tokens met for the first time get the number, hash and kind of their plain form.
            fresh = list(raw)[len(canon) :]
            plain = [tokens_of(t)[0] for t in fresh]
            for w in plain:
                if w not in names:
                    names[w] = len(seen)
                    seen.append(w)
            canon = np.concatenate([canon, np.array([names[w] for w in plain], np.int64)])
            added = seen[len(hashes) :]
            hashes = np.concatenate([hashes, np.array([_hash([w]) for w in added], np.uint64)])
            stopping = np.concatenate([stopping, np.array([w in _STOPS for w in added], np.int8)])
            word = canon[np.array(at)]
            # 0: more follows, 1: a stop follows, 2: the text ends here.
            flag = np.concatenate([stopping[word[1:]], np.zeros(1, np.int8)])
            flag[np.cumsum(line) - 1] = 2
            place = np.arange(len(word)) - np.repeat(np.cumsum([0, *line[:-1]]), line)
            h, vocabulary = hashes[word], pa.array(seen, pa.string())
            yield _stat_rows(0, np.zeros(len(word), np.uint64), word, flag, vocabulary)
            ctx, power = np.zeros(len(word), np.uint64), np.uint64(1)
            with np.errstate(over="ignore"):
                for k in CONTEXTS:
                    # The hash of the k words before: sum of h[i-j] * SEED^(j-1).
                    ctx[k:] += h[:-k] * power
                    power = power * _SEED
                    ok = np.flatnonzero(place >= k)
                    slot = _spark_filter_slots(k, ctx[ok].view(np.int64), 8 * len(bits))
                    keep = ok[((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)]
                    yield _stat_rows(k, ctx[keep], word[keep], flag[keep], vocabulary)
            if len(seen) > 2_000_000:  # bounds a worker's memory on endless vocabularies
                raw.clear()
                seen, names = [], {}
                canon, hashes, stopping = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)

    # Grouped by the texts themselves: exact, and a hot text shrinks to one row a task before the shuffle.
    texts = documents.where("text IS NOT NULL").select(F.rtrim("text", F.lit(BLANKS)).alias("text")).where("text <> ''").distinct()
    one = texts.mapInArrow(run, STATS)
    return one.groupBy("k", "ctx", "word").agg(*(F.sum(c).alias(c) for c in ("stops", "ends", "goes")))


_MIX = np.uint64(0xD6E8FEB86659FD93)


def _stat_rows(k: int, ctx: np.ndarray, word: np.ndarray, flag: np.ndarray, vocabulary: pa.Array) -> pa.RecordBatch:
    """Counts per (context, word); grouped by a 64-bit mix of both, as contexts are by a 64-bit hash."""
    with np.errstate(over="ignore"):
        key = (ctx + np.uint64(1)) * _MIX ^ word.astype(np.uint64) * _SEED
    inverse, keys = pd.factorize(key)
    first = np.zeros(len(keys), np.int64)
    first[inverse[::-1]] = np.arange(len(key) - 1, -1, -1)
    goes, stops, ends = (np.bincount(inverse[flag == f], minlength=len(first)) for f in (0, 1, 2))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), k, np.int32)), pa.array(ctx[first].view(np.int64)), vocabulary.take(pa.array(word[first])), pa.array(stops), pa.array(ends), pa.array(goes)],
        names=["k", "ctx", "word", "stops", "ends", "goes"],
    )


#: Prefixes up to this length have nodes of their own; longer ones are looked up behind their node.
TRIE_DEPTH = 32
COUNTS = ("stops", "ends", "goes")


def trie(stats: DataFrame, asked: DataFrame) -> DataFrame:
    """The trie's nodes for each ``(k, ctx, last)`` of ``asked``: how often the word itself stops, ends
    a text and goes on, and how often a longer word stands there that begins like it (``longer``)."""
    words = stats.where(F.length("word") > 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(TRIE_DEPTH))), lambda n: F.substring("word", F.lit(1), n))
    short = words.select("k", "ctx", "word", *COUNTS, F.explode(prefixes).alias("last"))
    wanted = checked_broadcast(asked.where(F.length("last") <= TRIE_DEPTH).select("k", "ctx", "last"), 200_000)
    # Asked prefixes are picked before the shuffle, so words are not sent once for each of theirs.
    nodes = short.join(wanted, ["k", "ctx", "last"])
    # A prefix deeper than the nodes meets the words below its node that are as deep.
    deep = asked.where(F.length("last") > TRIE_DEPTH).select("k", "ctx", "last", F.substring("last", 1, TRIE_DEPTH).alias("node"))
    below = words.where(F.length("word") > TRIE_DEPTH).withColumn("node", F.substring("word", 1, TRIE_DEPTH))
    nodes = nodes.unionByName(below.join(deep, ["k", "ctx", "node"]).where(F.startswith("word", "last")).select(nodes.columns))
    own = F.col("last") == F.col("word")
    return nodes.groupBy("k", "ctx", "last").agg(*(F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in COUNTS), F.sum(F.when(own, 0).otherwise(F.col("stops") + F.col("ends") + F.col("goes"))).alias("longer"))


def limits(ends: DataFrame) -> DataFrame:
    """Per source the lengths in characters (``limit_chars``), and in bytes, at which its texts pile up,
    as arrays: the longest of its texts and each that stands out among its neighbours. A pile holds
    a share of the source, so a source has few. Copies within a source count once."""
    texts = ends.select("source", "chars", "bytes", "copy").distinct()

    def found(size: str) -> DataFrame:
        per = texts.groupBy("source", F.col(size).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        # One row per source and length: no more than the longest text has characters.
        whole, by = Window.partitionBy("source"), Window.partitionBy("source").orderBy("v").rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)
        seen = per.select("source", "v", "n", F.sum("n").over(whole).alias("all"), F.max("v").over(whole).alias("top"), F.sum("n").over(by).alias("near"))
        pile = (F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("all"))
        out = (F.col("v") == F.col("top")) | (F.col("n") * 2 * LIMIT_NEAR >= LIMIT_PEAK * (F.col("near") - F.col("n")))
        return seen.groupBy("source").agg(F.sort_array(F.collect_list(F.when(pile & out, F.struct("v", "n")))).alias(size))

    # A limit in characters shows in bytes as well, and the other way round, for texts of plain letters.
    more = lambda size, than: F.transform(F.filter(size, lambda a: ~F.exists(than[0], lambda b: (b.v == a.v) & than[1](b.n, a.n))), lambda a: a.v)
    chars, size = more("chars", ("bytes", lambda b, a: b > a)), more("bytes", ("chars", lambda b, a: b >= a))
    return found("chars").join(found("bytes"), "source").select("source", chars.alias("limit_chars"), size.alias("limit_bytes"))


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id, source, mark, at_limit, share, evidence`` of the texts that were cut before their end.

    ``evidence``: ``word`` (the last token is unknown and begins known words), ``context`` (the
    corpus goes on after it), ``mark``, ``fence`` (an open code block) or ``lost`` (a broken
    letter). ``share``: how much of the corpus stops where the text does (null if no context tells).
    Null and blank texts are whole. Copies do not vouch for each other, however many there are:
    all counts are over distinct texts. A context counts from four occurrences on, of which the
    text's own is left out.
    """
    # One pass over the texts gives all ends; only those without full stop go on.
    found = cut(tails(documents))
    ends = found.where("k <= 0")
    open_tails = found.where("ending = 'open'")
    asked = cut(open_tails.select("k", "ctx", "last").distinct())
    nodes = trie(corpus_stats(documents, _filter(asked)), asked)
    # The text's own end is no evidence for itself.
    others = F.col("ends") - 1
    longer = F.col("longer")
    n = F.col("stops") + others + F.col("goes") + longer
    usual = (others >= USUAL_TEXTS) & (others >= USUAL_RATIO * (F.col("goes") + longer))
    share = F.when(usual, 1.0).otherwise((F.col("stops") + others) / n)
    # Known: the corpus has the token elsewhere, as a word of its own.
    begun = (F.col("k") == 0) & (F.col("stops") + others + F.col("goes") == 0) & (longer > 0)
    told = nodes.where(n >= SUPPORT).select("k", "ctx", "last", share.alias("share"), begun.alias("begun"))
    tail, told = salted(open_tails.select("doc_id", "k", "ctx", "last"), told, ["k", "ctx", "last"], ["doc_id"])
    per_tail = tail.join(told, ["k", "ctx", "last", "_salt"]).groupBy("doc_id").agg(F.max(F.struct("k", "share")).alias("s"), F.bool_or("begun").alias("begun"))
    rows = ends.select("doc_id", "source", "chars", "bytes", "mark", "ending").join(checked_broadcast(limits(ends)), "source").join(per_tail, "doc_id", "left")
    rows = rows.withColumns({"share": F.col("s.share"), "depth": F.col("s.k"), "at_limit": _at_limit(), "begun": F.coalesce("begun", F.lit(False))})
    return rows.withColumn("evidence", _evidence()).where("evidence IS NOT NULL").select("doc_id", "source", "mark", "at_limit", "share", "evidence")


def _at_limit() -> Column:
    """At most ``SLACK`` below a limit of the source, or as much above it as a mark is long."""
    near = lambda size: F.exists(f"limit_{size}", lambda v: (F.col(size) >= v - SLACK) & (F.col(size) <= v + 3))
    return near("chars") | near("bytes")


def _evidence() -> Column:
    """What tells that a text was cut, null if nothing does."""
    marked = F.col("mark") != ""
    share = F.coalesce("share", F.lit(0.0))
    exact = F.array_contains("limit_chars", F.col("chars")) | F.array_contains("limit_bytes", F.col("bytes"))
    bracket = F.col("mark").rlike(r"^[\[(<]")
    is_open = F.col("ending") == "open"
    # Unknown, and the beginning of known words; after mere dots it may be a name left as it is.
    word = is_open & F.col("begun") & (~marked | F.col("at_limit"))
    context = F.when(F.col("at_limit"), share < SHARE_AT_LIMIT).when(marked, (share < SHARE_MARKED) & (F.coalesce("depth", F.lit(0)) >= 2)).otherwise(share < SHARE)
    by_mark = bracket | marked & exact & (F.col("ending") == "stop")
    return F.when(F.col("ending").isin("fence", "lost"), F.col("ending")).when(word, "word").when(is_open & context, "context").when(by_mark, "mark")


def source_shares(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, and the share of them to four decimals."""
    every = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    cut_ = found.groupBy("source").agg(F.countDistinct("doc_id").alias("cut_texts"))
    n = F.coalesce("cut_texts", F.lit(0))
    return every.join(cut_, "source", "left").select("source", "texts", n.alias("cut_texts"), (F.floor(n / F.col("texts") * 10000 + 0.5) / 10000).alias("cut_share"))


def evidence_counts(found: DataFrame) -> DataFrame:
    """Cut texts per source by what tells that they were cut, and how many of them lie at a limit."""
    return found.groupBy("source", "evidence").agg(F.countDistinct("doc_id").alias("cut_texts"), F.count_if("at_limit").alias("at_limit"))
