"""Text scalar functions, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own (fixed values).
STOPWORDS = ("the", "a", "an", "of", "to", "and", "or", "is", "are", "be", "for", "in", "on", "with", "that", "this", "it", "as", "by", "from", "must", "not", "can", "will")
#: Offset basis and prime of 32-bit FNV-1a (fixed values).
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept; null stays null."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_words(c: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case ASCII words of two letters or more without stop words, sorted, repeats kept."""
    return F.array_sort(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def fnv1a(c: Column, buckets: int = 512) -> Column:
    """32-bit FNV-1a of an ASCII string, modulo ``buckets``."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    fold = F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)))
    return F.pmod(fold, F.lit(buckets))


def slug(c: Column) -> Column:
    """Lower case with every run of other signs as one hyphen; `test` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "test").otherwise(s)


def dotted(c: Column) -> Column:
    """Every separator of a name as one dot, in lower case, without outer dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[:\\/#\s().]+", "."), r"^\.+|\.+$", "")


def word_count(c: Column) -> Column:
    """Words by white space; 0 for blank text, null for null."""
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def inline(c: Column) -> Column:
    """White space collapsed to single spaces, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def segments(path: Column) -> Column:
    """Non-empty segments of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def wild_segments(path: Column) -> Column:
    """Segments with parameters (`:id`, `{id}`, `[id]`) as `{}`."""
    return F.transform(segments(path), lambda s: F.when(s.rlike(r"^(:.+|\{.*\}|\[.*\])$"), F.lit("{}")).otherwise(s))


def line_count(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line; 0 for empty text."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c == "", 0).otherwise(ends + F.when(F.substring(c, -1, 1) == "\n", 0).otherwise(1))


def canonical_hash(*cols: str) -> Column:
    """SHA-256 of the row's values as JSON with sorted names; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def short_sha(c: Column, size: int = 8) -> Column:
    """The first signs of a SHA-256."""
    return F.substring(F.sha2(c, 256), 1, size)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: `**/` any folders, `**` anything, `*` within a segment, `?` one sign."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return f"^{out}$"


def in_scope(path: Column, scope: str) -> Column:
    """The scope itself or anything under it; the empty scope holds everything."""
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def sentence_count(c: Column) -> Column:
    """Sentences by their final signs; text without any is one."""
    return F.greatest(F.size(F.filter(F.split(c, r"[.!?]+(\s+|$)"), lambda s: F.trim(s) != "")), F.lit(1))


def is_broad(c: Column) -> Column:
    """Too broad for one statement: 60 words in two sentences, three sentences, or 70 words."""
    w, s = word_count(c), sentence_count(c)
    return ((w >= 60) & (s >= 2)) | (s >= 3) | (w >= 70)


def has_prefixes(word_list: Column, terms: list[str]) -> Column:
    """Is every term the beginning of some word? No terms match everything."""
    out = F.lit(True)
    for term in terms:
        out = out & F.exists(word_list, _starts(term))
    return out


def _starts(term: str):
    return lambda w: w.startswith(term)
