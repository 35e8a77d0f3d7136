"""Scans of source trees: files, their language, and the symbols and references of Python files."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import glob_regex

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "go": "go", "php": "php", "sql": "sql"}
SYMBOLS = "file string, fqn string, name string, kind string, line int, end_line int, is_test boolean, error string"


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("**/node_modules/**", "**/.git/**")) -> DataFrame:
    """All files under a root: ``file, lang, size, text``; files of unknown extension have no language."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^(file:)?/*", "/")
    out = f.select(F.regexp_replace(rel, f"^{root.rstrip('/')}/", "").alias("file"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    for g in exclude:
        out = out.where(~F.col("file").rlike(glob_regex(g)))
    ext = F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)
    lang = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        lang = F.when(ext == e, name).otherwise(lang)
    return out.withColumn("lang", lang)


def _parse(file: str, source: str):
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield file, None, None, None, None, None, None, str(e)[:200]
        return
    module = file.removesuffix(".py").replace("/", ".")

    def walk(node, at: str, inside: bool):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if inside else "function"
                yield file, f"{at}.{n.name}", n.name, kind, n.lineno, n.end_lineno, n.name.lower().startswith("test"), None
                yield from walk(n, f"{at}.{n.name}", isinstance(n, ast.ClassDef))
            else:
                yield from walk(n, at, inside)

    yield from walk(tree, module, False)


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files; a file that does not parse gives one row with its error."""

    def run(batches):
        for pdf in batches:
            rows = [r for f, t in zip(pdf.file, pdf.text) for r in _parse(f, t or "")]
            yield pd.DataFrame(rows, columns=["file", "fqn", "name", "kind", "line", "end_line", "is_test", "error"]).astype({"line": "Int32", "end_line": "Int32"})

    return files.where("lang = 'python'").select("file", "text").mapInPandas(run, SYMBOLS)
