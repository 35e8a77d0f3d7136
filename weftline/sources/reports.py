"""Readers of test, coverage, mutation and change reports into plain tables.

Line formats are read as text and parsed inside the JVM; formats that are one document per
file (JSON and XML) use Spark's own readers. Bad lines and fields give no rows, not failures.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import deep


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("report"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """JUnit XML: ``suite, name, outcome`` (fail, skip, pass), suites nested or not; an empty report gives no rows."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_classname", "_name", "failure", "error", "skipped")])
    c = spark.read.schema(schema).option("rowTag", "testcase").option("nullValue", "\x00").option("treatEmptyValuesAsNulls", "false").format("xml").load(path)
    out = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "fail").when(F.col("skipped").isNotNull(), "skip").otherwise("pass")
    return c.where("_name IS NOT NULL").select(F.coalesce("_classname", F.lit("")).alias("suite"), F.col("_name").alias("name"), out.alias("outcome"))


def tap(spark: SparkSession, path: str) -> DataFrame:
    """TAP: ``report, number, name, outcome``; `# SKIP` and `# TODO` are skips."""
    p = r"^\s*(not ok|ok)\b\s*(\d+)?\s*(?:-\s*)?(.*?)\s*(?:#\s*(?i:(skip|todo))\b.*)?$"
    x = lambda i: F.regexp_extract("line", p, i)
    out = F.when(x(4) != "", "skip").when(x(1) == "ok", "pass").otherwise("fail")
    return _lines(spark, path).where(F.col("line").rlike(r"^\s*(not ok|ok)\b")).select("report", x(2).try_cast("int").alias("number"), x(3).alias("name"), out.alias("outcome"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """LCOV: ``file, line, hits``, one row per `DA` record."""
    rec = spark.read.option("lineSep", "end_of_record").text(path)
    rows = rec.select(F.regexp_extract("value", r"(?m)^SF:(.+)$", 1).alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))).alias("d"))
    return rows.where("file <> ''").select(F.trim("file").alias("file"), F.split("d", ",").getItem(0).cast("int").alias("line"), F.split("d", ",").getItem(1).cast("long").alias("hits"))


def go_cover(spark: SparkSession, path: str) -> DataFrame:
    """Go cover profile: ``file, line, hits``; a block's count holds for each of its lines, the largest counts."""
    p = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    x = lambda i: F.regexp_extract("line", p, i)
    b = _lines(spark, path).where(F.col("line").rlike(p)).select(x(1).alias("file"), x(2).cast("int").alias("lo"), x(3).cast("int").alias("hi"), x(4).cast("long").alias("hits"))
    return b.where("lo <= hi").select("file", F.explode(F.sequence("lo", "hi")).alias("line"), "hits").groupBy("file", "line").agg(F.max("hits").alias("hits"))


_STATEMENT = "struct<start: struct<line: int>>"


def istanbul(spark: SparkSession, path: str) -> DataFrame:
    """Istanbul JSON: ``file, line, hits`` of its statements."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<statementMap: map<string, {_STATEMENT}>, s: map<string, bigint>>>").alias("m"))
    f = doc.select(F.explode("m").alias("file", "c")).select("file", "c.s", F.explode("c.statementMap").alias("k", "st"))
    return f.select("file", F.col("st.start.line").alias("line"), F.try_element_at("s", F.col("k")).alias("hits")).where("line IS NOT NULL").groupBy("file", "line").agg(F.max(F.coalesce("hits", F.lit(0))).alias("hits"))


def coverage_py(spark: SparkSession, path: str) -> DataFrame:
    """coverage.py JSON: ``file, line, hits, test`` with one row per context of a line; test is empty without contexts."""
    s = "struct<files: map<string, struct<executed_lines: array<int>, missing_lines: array<int>, contexts: map<string, array<string>>>>>"
    f = spark.read.text(path, wholetext=True).select(F.from_json("value", s).alias("d")).select(F.explode("d.files").alias("file", "c"))
    run = f.select("file", F.explode("c.executed_lines").alias("line"), "c.contexts").select("file", "line", F.lit(1).alias("hits"), F.explode_outer(F.try_element_at("contexts", F.col("line").cast("string"))).alias("test"))
    missed = f.select("file", F.explode("c.missing_lines").alias("line"), F.lit(0).alias("hits"), F.lit("").alias("test"))
    return run.withColumn("test", F.coalesce("test", F.lit(""))).unionByName(missed)


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Cobertura XML: ``file, line, hits``."""
    s = "_filename string, lines struct<line: array<struct<_number: int, _hits: bigint>>>"
    c = spark.read.schema(s).option("rowTag", "class").format("xml").load(path)
    return c.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l")).groupBy("file", F.col("l._number").alias("line")).agg(F.sum("l._hits").alias("hits"))


def clover(spark: SparkSession, path: str) -> DataFrame:
    """Clover XML: ``file, line, hits`` of statements."""
    s = "_name string, _path string, line array<struct<_num: int, _count: bigint, _type: string>>"
    c = spark.read.schema(s).option("rowTag", "file").format("xml").load(path)
    return c.select(F.coalesce("_path", "_name").alias("file"), F.explode("line").alias("l")).where("l._type IS NULL OR l._type <> 'method'").groupBy("file", F.col("l._num").alias("line")).agg(F.sum("l._count").alias("hits"))


def call_counts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Database call counts as CSV with a header: ``file, test, function, calls`` (calls less those before)."""
    c = spark.read.option("header", True).csv(path)
    n = lambda x: F.coalesce(F.col(x).try_cast("long"), F.lit(0)) if x in c.columns else F.lit(0)
    text = lambda x: F.coalesce(F.col(x), F.lit("")) if x in c.columns else F.lit("")
    return c.select(text("file").alias("file"), text("test").alias("test"), F.concat_ws(".", "schema", "function").alias("function"), (n("calls") - n("calls_before")).alias("calls"))


def call_counts_json(spark: SparkSession, path: str) -> DataFrame:
    """Database call counts as JSON: ``file, test, function, calls``, each run less its `before`."""
    fn = "array<struct<schema: string, function: string, calls: bigint>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<runs: array<struct<test: string, file: string, functions: {fn}, before: {fn}>>>").alias("d"))
    runs = d.select(F.posexplode("d.runs").alias("n", "r"))
    e = F.lit("")
    side = lambda c, sign: runs.select("n", F.coalesce("r.file", e).alias("file"), F.coalesce("r.test", e).alias("test"), F.explode(f"r.{c}").alias("f")).select("n", "file", "test", F.concat_ws(".", "f.schema", "f.function").alias("function"), (F.col("f.calls") * sign).alias("c"), F.lit(sign).alias("s"))
    return side("functions", 1).unionByName(side("before", -1)).groupBy("n", "file", "test", "function").agg(F.sum("c").alias("calls"), F.max("s").alias("s")).where("s = 1").select("file", "test", "function", "calls")


def mutation(spark: SparkSession, path: str) -> DataFrame:
    """Mutation report JSON: ``file, killed, survived, score``; timeouts count as killed, other states not at all."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<files: map<string, struct<mutants: array<struct<status: string>>>>>").alias("d")).select(F.explode("d.files").alias("file", "f"))
    m = d.select("file", F.explode("f.mutants").alias("m"))
    is_ = lambda *s: F.sum(F.when(F.lower("m.status").isin(*s), 1).otherwise(0)).cast("long")
    g = m.groupBy("file").agg(is_("killed", "timeout").alias("killed"), is_("survived", "nocoverage").alias("survived"))
    return g.withColumn("score", F.try_divide(F.col("killed"), F.col("killed") + F.col("survived")))


def break_runs(spark: SparkSession, path: str) -> DataFrame:
    """Break runs, a JSON object with `runs` per file: ``promise, enforcer, outcome, not_run, failed``."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<runs: array<struct<promise: string, enforcer: string, outcome: string, not_run_verifiers: array<string>, failed_tests: array<string>>>>").alias("d"))
    return d.select(F.explode("d.runs").alias("r")).select("r.promise", "r.enforcer", "r.outcome", F.col("r.not_run_verifiers").alias("not_run"), F.col("r.failed_tests").alias("failed"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files `{area, nodes: [...]}`: one row per node with its area and file."""
    node = "struct<id: string, parent: string, kind: string, title: string, status: string, next: array<string>, calls: array<string>, fulfills: array<string>>"
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"struct<area: string, nodes: array<{node}>>").alias("d"))
    return d.select("source", "d.area", F.explode("d.nodes").alias("n")).select("source", "area", "n.*")


def ledger_schema() -> str:
    return "event string, unit string, actor string, evidence string, at timestamp_ntz"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log of JSON lines; bad, blank and unit-less lines are skipped."""
    d = spark.read.schema(ledger_schema()).option("mode", "DROPMALFORMED").json(path)
    return d.where("unit IS NOT NULL AND unit <> ''")


def name_status(spark: SparkSession, path: str) -> DataFrame:
    """`git diff --name-status` output: ``status, file, was`` (was: the old name of a rename or copy)."""
    p = F.split("line", "\t")
    ok = _lines(spark, path).where(F.col("line").rlike(r"^[ACDMRTUX]\d*\t"))
    two = F.size(p) > 2
    return ok.select(F.substring("line", 1, 1).alias("status"), F.when(two, p.getItem(2)).otherwise(p.getItem(1)).alias("file"), F.when(two, p.getItem(1)).alias("was"))


def hunks(spark: SparkSession, path: str) -> DataFrame:
    """Unified diffs: ``file, old_start, old_lines, new_start, new_lines`` per hunk. Each file of diffs is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)^(?=diff --git )"), lambda x: x.startswith("diff --git "))).alias("d"))
    h = whole.select(F.regexp_extract("d", r"(?m)^\+\+\+ (?:b/)?(.+)$", 1).alias("file"), F.explode(F.regexp_extract_all("d", F.lit(r"(?m)^@@ -(\d+(?:,\d+)? \+\d+(?:,\d+)?) @@"), F.lit(1))).alias("h"))
    x = lambda p, i, d: F.when(F.regexp_extract("h", p, i) == "", F.lit(d)).otherwise(F.regexp_extract("h", p, i).try_cast("int"))
    p = r"^(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?$"
    return h.select("file", x(p, 1, 0).alias("old_start"), x(p, 2, 1).alias("old_lines"), x(p, 3, 0).alias("new_start"), x(p, 4, 1).alias("new_lines"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """`git log --name-only --format=commit:%H` output: ``sha, file``. Each log is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^commit:")).alias("c")).where(F.trim("c") != "")
    rows = whole.select(F.trim(F.split("c", "\n").getItem(0)).alias("sha"), F.explode(F.expr("slice(split(c, '\n'), 2, greatest(size(split(c, '\n')) - 1, 0))")).alias("file"))
    return rows.select("sha", F.trim("file").alias("file")).where("file <> ''")


READERS = {"junit": junit, "tap": tap, "lcov": lcov, "go_cover": go_cover, "istanbul": istanbul, "coverage_py": coverage_py, "cobertura": cobertura, "clover": clover, "calls_csv": call_counts_csv, "calls_json": call_counts_json, "mutation": mutation}


def _top(head: str) -> tuple[list[str], list[str]]:
    """Names at the top of a JSON object, and in its first value, as far as the text goes."""
    top: list[str] = []
    first: list[str] = []
    depth = 0
    try:
        for kind, x in deep.events(head):
            depth += (kind in (deep.OPEN_OBJECT, deep.OPEN_LIST)) - (kind == deep.CLOSE)
            if kind == deep.KEY and depth == 1:
                top.append(x)
            elif kind == deep.KEY and depth == 2 and len(top) == 1:
                first.append(x)
    except ValueError:  # the rest of the text is not there
        pass
    return top, first


def sniff(head: str) -> str | None:
    """The format of a report by its first part, or None."""
    s = head.lstrip("\ufeff \t\r\n")
    if s.startswith("<"):
        tags = re.findall(r"<([A-Za-z_][\w.-]*(?::[\w.-]+)?)", re.sub(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", s))[:2]
        if tags and tags[0] in ("testsuites", "testsuite"):
            return "junit"
        if tags and tags[0] == "coverage":
            return "clover" if tags[1:] == ["project"] else "cobertura"
        return None
    if s.startswith("mode:"):
        return "go_cover"
    if re.match(r"(TN:|SF:)", s):
        return "lcov"
    if re.match(r"(TAP version \d+|\d+\.\.\d+|ok\b|not ok\b)", s):
        return "tap"
    if s.startswith("{"):
        top, first = _top(s)
        if {"meta", "files"} <= set(top):
            return "coverage_py"
        if "format" in top and re.search(r'"format"\s*:\s*"pg_stat_user_functions"', s):
            return "calls_json"
        if "statementMap" in first:
            return "istanbul"
        return "mutation" if "files" in top and '"mutants"' in s else None
    columns = {c.strip().strip('"').lower() for c in s.split("\n", 1)[0].split(",")}
    return "calls_csv" if {"schema", "function", "calls"} <= columns else None


def read_report(spark: SparkSession, path: str, head: int = 1 << 20) -> tuple[str, DataFrame]:
    """Reports of one format, which the beginning of each file shows; ValueError if it shows none or
    if the files show several."""

    def run(batches):
        for b in batches:
            found = [sniff(bytes(c.as_py() or b"").decode("utf-8", "replace")) or "" for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["path", "format"])

    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, head).alias("c"))
    # No more rows than there are formats.
    seen = {r["format"]: r["path"] for r in heads.mapInArrow(run, "path string, format string").groupBy("format").agg(F.min("path").alias("path")).collect()}
    if len(seen) != 1 or "" in seen:
        raise ValueError(f"unknown report format: {seen.get('', path)}" if len(seen) < 2 or "" in seen else f"reports of several formats: {sorted(seen)}")
    name = next(iter(seen))
    return name, READERS[name](spark, path)
