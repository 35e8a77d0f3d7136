"""Evaluation texts leaking into training text (problem 7): a prefix-filtered set join.

Items are cut into shingles of five words, which stand in one order from rare to frequent, as the
words in all documents tell. Each item's necessary prefix are its rarest shingles, of which every
document that holds enough of it must share one; only these are searched for. A document is read
as one stream of letters and digits, so that case, punctuation, spacing, markup and broken words
fall away. Pairs that share a prefix shingle must pass bounds of length, count and position, and
are then verified word by word over windows of the item's size.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scale import cut, small_or_none

#: Words in a shingle, in a stretch, in all stretches; words of which one may be altered or left out.
SHINGLE, STRETCH, LEAST_WORDS, ONE_IN = 5, 15, 20, 8
#: Words that may stand between two words of a stretch besides those they replace.
STRAY_WORDS = 3
#: Words without a shared shingle that a stretch may run on behind one: six runs of four words and
#: five altered ones. By as many and the stray ones its two sides may shift against each other.
REACH, DRIFT = 30, 5 + STRAY_WORDS
#: Letters of the items that are searched for at once; more are taken in blocks.
BLOCK_LETTERS = 4_000_000

_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h\d|hr|pre|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿᠎\u0000-\u0008]")
_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*\n[\s>|#*/;%+-]*(?=\w)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, markup, line marks, invisible characters and breaks."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(_BREAK.sub("", text).casefold())


@lru_cache(maxsize=None)
def least_shared(words: int) -> int:
    """Fewest five-word shingles kept by stretches of ``words`` words or more in sum: a stretch
    of L words has L - 4, and each word altered or left out destroys up to five."""
    most = words + STRETCH
    kept = {length: length - SHINGLE + 1 - SHINGLE * (length // ONE_IN) for length in range(STRETCH, most + 1)}
    best = [0] + [10**9] * most
    for total in range(1, most + 1):
        best[total] = min((best[total - n] + k for n, k in kept.items() if n <= total and best[total - n] < 10**9), default=10**9)
    return max(1, min(best[words:]))


def needed(words: int) -> int:
    """Words of an item that a document must hold."""
    return max(LEAST_WORDS, -(-words // 3))


Block = tuple[int, int, int]  # place in the item, place in the document, words


def _anchors(item: list[str], doc: list[str]) -> list[Block]:
    """The longest runs of five words or more that both hold, along each diagonal."""
    at: dict[tuple[str, ...], list[int]] = {}
    for i, gram in enumerate(zip(*(item[k:] for k in range(SHINGLE)))):
        at.setdefault(gram, []).append(i)
    first = {g[0] for g in at}
    open_: dict[int, list[int]] = {}
    runs = []
    for p in range(len(doc) - SHINGLE + 1):
        if doc[p] in first:
            for i in at.get(tuple(doc[p : p + SHINGLE]), ()):
                run = open_.get(p - i)
                if run and run[1] + run[2] - SHINGLE + 1 == p:
                    run[2] += 1
                else:
                    open_[p - i] = run = [i, p, SHINGLE]
                    runs.append(run)
    return [(i, p, n) for i, p, n in runs]


def _groups(anchors: list[Block]) -> list[list[Block]]:
    """Anchors that may lie in one stretch together: near each other in the document, on diagonals
    that differ by no more than words left out and put in make them differ."""
    groups: list[list[Block]] = []
    for a in sorted(anchors, key=lambda x: (x[1], x[0])):
        near = [g for g in groups if any(a[1] - (p + n) <= REACH and abs((a[1] - a[0]) - (p - i)) <= DRIFT for i, p, n in g)]
        if near:
            for g in near[1:]:
                near[0].extend(g)
                groups.remove(g)
            near[0].append(a)
        else:
            groups.append([a])
    return groups


def _blocks_near(item: list[str], doc: list[str], places: dict[str, list[int]], group: list[Block]) -> list[Block]:
    """All runs of equal words, single ones too, in reach of a group of anchors and near its diagonals."""
    low, high = min(p for _, p, _ in group) - REACH, max(p + n for _, p, n in group) + REACH
    first, last = min(i for i, _, _ in group) - REACH, max(i + n for i, _, n in group) + REACH
    left, right = min(p - i for i, p, _ in group) - DRIFT, max(p - i for i, p, _ in group) + DRIFT
    open_: dict[int, list[int]] = {}
    runs = []
    for p in range(max(0, low), min(len(doc), high)):
        for i in places.get(doc[p], ()):
            if left <= p - i <= right and first <= i < last:
                run = open_.get(p - i)
                if run and run[1] + run[2] == p:
                    run[2] += 1
                else:
                    open_[p - i] = run = [i, p, 1]
                    runs.append(run)
    return [(i, p, n) for i, p, n in runs]


def _spans(blocks: list[Block], most_missing: int) -> Iterator[tuple[int, int]]:
    """First and last item place of the stretches that the blocks make: 15 words or more, of which
    at most one in eight is altered or left out; for each block and number of missing words the
    longest that ends there. In a stretch both sides rise, and no more than ``STRAY_WORDS`` are put
    in between two blocks beside those they replace.
    """
    blocks = sorted(blocks, key=lambda b: (b[1] + b[2], b[0] + b[2]))
    best: list[dict[int, int]] = []  # by words missing so far: most words held
    for k, (i, p, n) in enumerate(blocks):
        top = {0: n}
        for j in range(k - 1, -1, -1):
            li, lp, ln = blocks[j]
            if p - (lp + ln) > most_missing + STRAY_WORDS:
                break
            off = max(0, li + ln - i, lp + ln - p)  # where both overlap, the later one gives way
            missing, put_in = i + off - (li + ln), p + off - (lp + ln)
            if off < n and missing <= most_missing and put_in - missing <= STRAY_WORDS:
                for m, held in best[j].items():
                    if m + missing <= most_missing and held + n - off > top.get(m + missing, 0):
                        top[m + missing] = held + n - off
        best.append(top)
        for m, held in top.items():
            if held + m >= STRETCH and m * ONE_IN <= held + m:
                yield i + n - held - m, i + n - 1


#: Longer words are words run together.
RUN_TOGETHER = 24


def _mend(doc: list[str], known: set[str], inside: re.Pattern) -> list[str]:
    """Join two neighbours that are one of the item's words broken in two, and part item words that run together."""
    out: list[str] = []
    for w in doc:
        if w in known:
            if out and out[-1] not in known and out[-1] + w in known:
                out[-1] += w
            else:
                out.append(w)
        elif len(w) > RUN_TOGETHER:
            at = 0
            for m in inside.finditer(w):
                out += [w[at : m.start()], m[0]] if m.start() > at else [m[0]]
                at = m.end()
            out += [w[at:]] if at < len(w) else []
        elif cut_at := next((i for i in range(1, len(w)) if w[:i] in known and w[i:] in known), 0):
            out += [w[:cut_at], w[cut_at:]]
        elif out and out[-1] + w in known:
            out[-1] += w
        else:
            out.append(w)
    return out


class Item:
    """An item's words and what its verification needs again for every document."""

    def __init__(self, words: list[str]):
        self.words, self.known = words, set(words)
        self.wanted = needed(len(words))
        self.shared = least_shared(self.wanted)
        lengths = sorted(map(len, words))
        self.least_letters = sum(lengths[: self.wanted - self.wanted // ONE_IN])
        # Between two shingles of a stretch lie at most the item and what was altered or put in.
        self.window = sum(lengths) + RUN_TOGETHER * (STRAY_WORDS + 1) * (len(words) // ONE_IN + 1)
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.places.setdefault(w, []).append(i)
        self.inside = re.compile("|".join(map(re.escape, sorted(self.known, key=len, reverse=True))) or "(?!)")

    def held(self, doc: list[str]) -> int:
        """Words of the item in admissible stretches of the document, which is taken as it is."""
        anchors = _anchors(self.words, doc)
        held: set[int] = set()
        for i, _, n in anchors:
            if n >= STRETCH:
                held.update(range(i, i + n))
        if len(held) >= self.wanted:
            return len(held)
        for group in _groups(anchors):
            for a, b in _spans(_blocks_near(self.words, doc, self.places, group), len(self.words) // ONE_IN):
                held.update(range(a, b + 1))
        return len(held)

    def holds(self, doc: list[str]) -> int:
        """Words of the item that the document holds, broken words mended where that is needed to tell."""
        n = self.held(doc)
        return n if n >= self.wanted else max(n, self.held(_mend(doc, self.known, self.inside)))


def holds(item: list[str], doc: list[str]) -> int:
    return Item(item).holds(doc)


def _one_each(items: DataFrame) -> DataFrame:
    return items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))


def _normalised(df: DataFrame, key: str) -> DataFrame:
    """``key, words``: the words of each text, with a space between them."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words_of(t)) for t in b.column(1).to_pylist()], pa.string())], names=[key, "words"])

    return df.select(F.col(key).cast("long"), "text").mapInArrow(run, f"{key} long, words string")


#: Distinct words of all items that are sent to every task; beyond it the counts are joined by shuffle.
MOST_WORDS = 200_000


def _word_counts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``w, n``: in how many documents each word of the items stands. Each task sends a word once."""
    known = items.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).distinct()
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w"))
    counted = lambda df: df.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    few = small_or_none(known, MOST_WORDS)
    if few is None:
        return counted(words).join(known, "w")
    return counted(words.join(F.broadcast(texts.sparkSession.createDataFrame(few, known.schema)), "w"))


def _prefixes(items: list[tuple[int, list[str]]], counts: dict[str, int]) -> tuple[dict[str, list[int]], dict[int, list[str]]]:
    """The prefix shingles with the items that have them, and the other shingles of each item.

    All shingles stand in one order, from rare to frequent, as the words in them tell. A document
    that holds enough of an item has ``least_shared`` of its shingles or more, so it has one of all
    but the last ``least_shared - 1``.
    """
    rarity: dict[str, float] = {}
    prefix: dict[str, list[int]] = {}
    rest: dict[int, list[str]] = {}
    for item, words in items:
        own = {"".join(words[i : i + SHINGLE]): words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1)}
        for s, w in own.items():
            rarity.setdefault(s, sum(math.log1p(counts.get(x, 0)) for x in w))
        order = sorted(own, key=lambda s: (rarity[s], s))
        n = max(1, len(order) - least_shared(needed(len(words))) + 1)
        for s in order[:n]:
            prefix.setdefault(s, []).append(item)
        rest[item] = order[n:]
    return prefix, rest


def in_place(hits: list[tuple[int, int]], window: int) -> set[int]:
    """The shingles among ``hits (place in the document, shingle)`` that have another hit within a
    window of so many letters. A stretch holds two shingles or more, so one alone belongs to none."""
    hits = sorted(hits)
    return {s for (p, a), (q, b) in zip(hits, hits[1:]) if q - p <= window for s in (a, b)}


class _Search:
    """All that a worker needs of a block of items; made once a process."""

    def __init__(self, items: list[tuple[int, list[str]]], prefix: dict[str, list[int]], rest: dict[int, list[str]]):
        import ahocorasick

        self.items, self.rest = {i: Item(w) for i, w in items}, rest
        self.find = ahocorasick.Automaton()
        for n, (s, own) in enumerate(prefix.items()):
            self.find.add_word(s, (n, own))
        self.find.make_automaton()

    def leaks(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """``item, words held, item words`` of a document."""
        stream = "".join(words)
        found: dict[int, list[tuple[int, int]]] = {}
        for at, (n, own) in self.find.iter(stream):
            for item in own:
                found.setdefault(item, []).append((at, n))
        for item, hits in found.items():
            it, rest = self.items[item], self.rest[item]
            # Length bound, in letters since words may run together; then count and positional bounds.
            if len(stream) < it.least_letters or len({n for _, n in hits}) + len(rest) < it.shared:
                continue
            for k, s in enumerate(rest):
                at = stream.find(s)
                while at >= 0:
                    hits.append((at + len(s) - 1, -1 - k))
                    at = stream.find(s, at + 1)
            if len({n for _, n in hits}) < it.shared or len(in_place(hits, it.window)) < it.shared:
                continue
            if (n := it.holds(words)) >= it.wanted:
                yield item, n, len(it.words)


LEAKS = "doc_id long, item_id long, words_held int, item_words int"


def _block_leaks(words: DataFrame | None, texts: DataFrame, items: list[tuple[int, list[str]]], counts: dict[str, int]) -> DataFrame:
    """The leaks of one block of items in one pass over the documents, or their words if they are there."""
    held = texts.sparkSession.sparkContext.broadcast({"block": (items, *_prefixes(items, counts))})
    ready = words is not None

    def scan(batches):
        if "search" not in held.value:
            held.value["search"] = _Search(*held.value["block"])
        search = held.value["search"]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(doc, *x) for x in search.leaks(text.split(" ") if ready else words_of(text))]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "words_held", "item_words"])

    return (words if ready else texts).mapInArrow(scan, LEAKS)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words_held, item_words``: documents that hold a third of an item's
    words, and 20 or more, in stretches of 15 or more with at most one word in eight altered.

    Null texts and ids, and items of fewer than 20 words, give no rows; repeated rows give one.
    Whole texts are searched; a hot source or much copied text is spread like any other. Items that
    have more letters than ``BLOCK_LETTERS`` are taken in blocks; the documents are then brought
    into words once, and the words searched once a block.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    known = cut(_normalised(_one_each(items), "item_id"))
    counts = cut(_word_counts(texts, known))
    blocks = -(-(known.agg(F.sum(F.length("words"))).first()[0] or 0) // BLOCK_LETTERS)
    words = cut(_normalised(texts, "doc_id")) if blocks > 1 else None
    out = None
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        # The driver holds a block of items and the counts of their words at a time.
        rows = [(r["item_id"], w) for r in part.collect() if len(w := r["words"].split(" ")) >= LEAST_WORDS]
        if rows:
            own = part.select(F.explode(F.split("words", " ")).alias("w")).distinct()
            found = _block_leaks(words, texts, rows, {r["w"]: r["n"] for r in counts.join(own, "w").collect()})
            out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else spark.createDataFrame([], T._parse_datatype_string(LEAKS))
