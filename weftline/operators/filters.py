"""Filters and predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import content_words

_TERM = re.compile(r"^(\w+)(<=|>=|=|<|>)(.+)$")


def search(df: DataFrame, wanted: dict[str, str], order: list[str], limit: int = 50) -> DataFrame:
    """Rows equal to every non-empty wanted value (an empty one stands for any), the first
    ``limit`` distinct ones by ``order``: a page of a search result."""
    hit = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v), df)
    return hit.select(*order).distinct().orderBy(*order).limit(limit)


def parse_predicate(expression: str, prefixes: dict[str, str], numbers: dict[str, str]) -> Column:
    """A small language of terms joined by `and`: ``name=prefix`` on text, ``name op number`` on
    numbers. Raises ValueError on anything else."""
    out = F.lit(True)
    for term in expression.split():
        m = _TERM.match(term)
        if m and m[1] in prefixes and m[2] == "=":
            out = out & F.col(prefixes[m[1]]).startswith(m[3])
        elif m and m[1] in numbers:
            c, v = F.col(numbers[m[1]]), float(m[3])
            out = out & {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[m[2]]
        else:
            raise ValueError(f"not a term: {term}")
    return out


def narrowed_counts(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows of each wanted key, with unknown keys reported back."""
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    n = df.where(F.col(key).isin(*wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, key, "left").select(key, F.when(F.col("n").isNull(), "unknown").otherwise("known").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def is_product(file: Column) -> Column:
    """Not a declaration or configuration file."""
    return ~file.rlike(r"(\.d\.ts|\.config\.[a-z]+)$")


def is_implementation(kind: Column, exported: Column) -> Column:
    """An exported class, function, method or trait."""
    return kind.isin("class", "function", "method", "trait") & exported


def attribution(symbols: DataFrame) -> DataFrame:
    """Per file: has it production code, and is any of it attributed to a feature? Null test flags count as production."""
    code = ~F.coalesce("is_test", F.lit(False)) & F.col("kind").isin("class", "function", "method", "trait")
    return symbols.groupBy("file").agg(F.bool_or(code).alias("production"), F.bool_or(F.col("feature").isNotNull()).alias("attributed"))


def with_severity(df: DataFrame, code: str, override: dict[str, str], default: str) -> DataFrame:
    """The severity of each finding: its code's override or the default."""
    pairs = F.create_map(*(F.lit(x) for kv in override.items() for x in kv))
    return df.withColumn("severity", F.coalesce(F.try_element_at(pairs, F.col(code)), F.lit(default)))


def allowlisted(findings: DataFrame, allow: DataFrame, key: str) -> DataFrame:
    """Findings accepted by the list, those open, and entries of the list that match none: ``state, n``."""
    n = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = n.join(allow.select(key).distinct().withColumn("_l", F.lit(True)), key, "full_outer")
    state = F.when(F.col("n").isNull(), "stale").when(F.col("_l"), "accepted").otherwise("open")
    return j.select(state.alias("state"), F.coalesce("n", F.lit(1)).alias("n")).groupBy("state").agg(F.sum("n").alias("n"))


def active(df: DataFrame, expires: str, now: str) -> DataFrame:
    """Rows whose end is absent, unreadable or later than ``now``."""
    at = F.col(expires).cast("string").try_cast("timestamp_ntz")
    return df.where(at.isNull() | (at > F.lit(now).cast("timestamp_ntz")))


#: Compound names that say nothing in a test (fixed values), compared without case.
COMMON_NAMES = """
beforeEach afterEach beforeAll afterAll setUp tearDown setUpClass
toBe toEqual toBeVisible toHaveText toContain toMatch toThrow
getByRole getByText getByTestId getByLabel getByLabelText querySelector
forEach toString toJSON valueOf hasOwnProperty isArray
useState useEffect useMemo useCallback useRef useContext setState
onClick onChange onSubmit onLoad onError onClose
isEmpty isValid isEnabled getValue setValue getName setName getData
setData getItem setItem getId
"""


def mentionable(name: Column, common: str = COMMON_NAMES) -> Column:
    """A compound name of four signs or more, not beginning with a digit, that is not a common one. It
    joins words by a capital letter (``totalFee``, ``HTTPServer``) or by ``_`` between letters or digits."""
    compound = name.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z0-9]_[A-Za-z0-9]")
    return (F.length(name) >= 4) & ~name.rlike("^[0-9]") & compound & ~F.lower(name).isin(*common.lower().split())


def narrowing_terms(rows: DataFrame, promises: DataFrame, key: str, statement: str, promise: str) -> DataFrame:
    """Content words of a row's statement that its promise lacks: ``row_id, terms`` (by comma); rows without any are left out."""
    j = rows.join(promises, key).withColumn("t", F.array_sort(F.array_except(F.array_distinct(content_words(F.col(statement))), content_words(F.col(promise)))))
    return j.where(F.size("t") > 0).select("row_id", F.array_join("t", ",").alias("terms")).distinct()
