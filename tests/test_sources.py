import json
import os

import pytest

from weftline.sources import code, reports, sinks


def put(tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text)
    return str(f)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_junit(spark, tmp_path):
    f = put(tmp_path, "a.xml", '<testsuites><testsuite name="s"><testcase classname="C" name="ok"/><testsuite><testcase name="bad"><failure message="m">x</failure></testcase></testsuite><testcase classname="C" name="skip"><skipped/></testcase></testsuite></testsuites>')
    assert rows(reports.junit(spark, f), "suite", "name", "outcome") == [("", "bad", "fail"), ("C", "ok", "pass"), ("C", "skip", "skip")]
    assert reports.junit(spark, put(tmp_path, "b.xml", "<testsuites></testsuites>")).count() == 0


def test_line_formats(spark, tmp_path):
    f = put(tmp_path, "t.tap", "TAP version 13\n1..4\nok 1 - first\nnot ok 2 second # x\nok 3 third # SKIP later\n# note\nnot ok 4 - fourth # TODO\n")
    assert rows(reports.tap(spark, f), "number", "name", "outcome") == [(1, "first", "pass"), (2, "second # x", "fail"), (3, "third", "skip"), (4, "fourth", "skip")]
    f = put(tmp_path, "l.info", "TN:\nSF:a.ts\nDA:1,2\nDA:3,0\nend_of_record\nSF:b.ts\nDA:9,1\nend_of_record\n")
    assert rows(reports.lcov(spark, f), "file", "line", "hits") == [("a.ts", 1, 2), ("a.ts", 3, 0), ("b.ts", 9, 1)]
    f = put(tmp_path, "c.out", "mode: set\nm/a.go:3.2,5.10 2 1\nm/a.go:5.10,6.2 1 0\nbroken\n")
    assert rows(reports.go_cover(spark, f), "file", "line", "hits") == [("m/a.go", 3, 1), ("m/a.go", 4, 1), ("m/a.go", 5, 1), ("m/a.go", 6, 0)]
    f = put(tmp_path, "calls.csv", "file,test,schema,function,calls,calls_before\nf,t,public,go,5,2\n")
    assert rows(reports.call_counts_csv(spark, f), "file", "test", "function", "calls") == [("f", "t", "public.go", 3)]


def test_documents(spark, tmp_path):
    f = put(tmp_path, "i.json", json.dumps({"a.ts": {"statementMap": {"0": {"start": {"line": 4}}, "1": {"start": {"line": 4}}}, "s": {"0": 0, "1": 3}}}))
    assert rows(reports.istanbul(spark, f), "file", "line", "hits") == [("a.ts", 4, 3)]
    f = put(tmp_path, "p.json", json.dumps({"files": {"a.py": {"executed_lines": [1, 2], "missing_lines": [3], "contexts": {"1": ["t1", "t2"]}}}}))
    assert rows(reports.coverage_py(spark, f), "file", "line", "hits", "test") == [("a.py", 1, 1, "t1"), ("a.py", 1, 1, "t2"), ("a.py", 2, 1, ""), ("a.py", 3, 0, "")]
    f = put(tmp_path, "c.xml", '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(reports.cobertura(spark, f), "file", "line", "hits") == [("a.py", 1, 2), ("a.py", 2, 0)]
    f = put(tmp_path, "cl.xml", '<coverage clover="3"><project><file name="a.php" path="/x/a.php"><line num="1" type="stmt" count="4"/><line num="2" type="method" count="1"/></file></project></coverage>')
    assert rows(reports.clover(spark, f), "file", "line", "hits") == [("/x/a.php", 1, 4)]
    f = put(tmp_path, "m.json", json.dumps({"files": {"a": {"mutants": [{"status": "Killed"}, {"status": "Survived"}, {"status": "Timeout"}, {"status": "Ignored"}]}}}))
    assert rows(reports.mutation(spark, f), "file", "killed", "survived") == [("a", 2, 1)]
    fn = [{"schema": "s", "function": "f", "calls": 7}]
    f = put(tmp_path, "calls.json", json.dumps({"runs": [{"test": "t", "functions": fn, "before": [{"schema": "s", "function": "f", "calls": 2}, {"schema": "s", "function": "gone", "calls": 1}]}]}))
    assert rows(reports.call_counts_json(spark, f), "file", "test", "function", "calls") == [("", "t", "s.f", 5)]
    f = put(tmp_path, "b.json", json.dumps({"runs": [{"promise": "p", "enforcer": "e", "outcome": "killed", "failed_tests": ["t"]}]}))
    assert rows(reports.break_runs(spark, f), "promise", "outcome") == [("p", "killed")]
    f = put(tmp_path, "cat.json", json.dumps({"area": "x", "nodes": [{"id": "a", "next": ["b"]}, {"id": "b", "parent": "a"}]}))
    assert rows(reports.catalogue(spark, f), "area", "id", "parent") == [("x", "a", None), ("x", "b", "a")]


def test_changes(spark, tmp_path):
    f = put(tmp_path, "n.txt", "M\ta.py\nR090\told.py\tnew.py\nnoise\nD\tb.py\n")
    assert rows(reports.name_status(spark, f), "status", "file", "was") == [("D", "b.py", None), ("M", "a.py", None), ("R", "new.py", "old.py")]
    f = put(tmp_path, "d.diff", "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n@@ -9 +10 @@\ndiff --git a/y b/y\n+++ b/y\n@@ -0,0 +1,5 @@\n")
    assert rows(reports.hunks(spark, f), "file", "old_start", "old_lines", "new_start", "new_lines") == [("x", 1, 2, 1, 3), ("x", 9, 1, 10, 1), ("y", 0, 0, 1, 5)]
    f = put(tmp_path, "log", "commit:abc\n\na.py\nb.py\n\ncommit:def\n\na.py\n")
    assert rows(reports.commits(spark, f), "sha", "file") == [("abc", "a.py"), ("abc", "b.py"), ("def", "a.py")]
    f = put(tmp_path, "l.jsonl", '{"event": "e", "unit": "u", "actor": "a"}\nbad\n\n{"event": "e"}\n')
    assert rows(reports.ledger(spark, f), "event", "unit") == [("e", "u")]


@pytest.mark.parametrize(("head", "name"), [("mode: set\n", "go_cover"), ("TN:\nSF:x", "lcov"), ("1..2\nok 1", "tap"), ("<testsuites>", "junit"), ('<coverage line-rate="1">', "cobertura"), ('<coverage clover="3">', "cobertura"), ('<?xml version="1.0"?><!-- <x> --><coverage generated="3"><project>', "clover"), ("<coverage><project", "clover"), ("<testsuite", "junit"), ('{"meta": {"v": 1}, "files": {"a": {"exec', "coverage_py"), ('{"format": "pg_stat_user_functions", "runs": [', "calls_json"), ('{"files": {"a": {"mutants": [', "mutation"), ("Calls, SCHEMA ,function", "calls_csv"), ("my function calls", None), ('{"a": {"statementMap": {}}}', "istanbul"), ("file,schema,function,calls", "calls_csv"), ("hello", None), ("<html>", None), ("{}", None), ("", None)])
def test_sniff(head, name):
    assert reports.sniff(head) == name


def test_read_report(spark, tmp_path):
    name, df = reports.read_report(spark, put(tmp_path, "x", "mode: set\na.go:1.1,1.2 1 1\n"))
    assert name == "go_cover" and df.count() == 1
    with pytest.raises(ValueError):
        reports.read_report(spark, put(tmp_path, "y", "what"))
    (tmp_path / "many").mkdir()
    put(tmp_path, "many/a", "mode: set\na.go:1.1,1.2 1 1\n")
    put(tmp_path, "many/b", "TN:\nSF:x\n")
    with pytest.raises(ValueError, match="several"):
        reports.read_report(spark, str(tmp_path / "many"))


def test_code_scan(spark, tmp_path):
    (tmp_path / "src/node_modules/z").mkdir(parents=True)
    put(tmp_path, "src/a.py", "class A:\n    def m(self):\n        pass\n\ndef test_x():\n    pass\n")
    put(tmp_path, "src/bad.py", "def (")
    put(tmp_path, "src/node_modules/z/i.js", "x")
    files = code.scan(spark, str(tmp_path / "src"))
    assert rows(files, "file", "lang") == [("a.py", "python"), ("bad.py", "python")]
    got = {(r["fqn"], r["kind"], r["line"], r["is_test"]) for r in code.python_symbols(files).where("error IS NULL").collect()}
    assert got == {("a.A", "class", 1, False), ("a.A.m", "method", 2, False), ("a.test_x", "function", 5, True)}
    assert code.python_symbols(files).where("error IS NOT NULL").count() == 1


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", "g.x"), (2, None, "g.y"), (2, None, "g.y")], "id int, v string, grp string")
    assert sinks.write_if_changed(df, at) and not sinks.write_if_changed(df.orderBy("v").repartition(3), at)
    assert sinks.write_if_changed(df.limit(2), at) and sinks.current(spark, at).count() == 2
    held = sinks.current(spark, at)
    sinks.swap(df.limit(1), at)
    assert held.count() == 2 and sinks.current(spark, at).count() == 1  # a reader of the version before reads on
    sinks.swap(df, at)
    assert len([f for f in os.listdir(at) if f.startswith("v-")]) == 2 and sinks.current(spark, str(tmp_path / "none")) is None
    sinks.write_sharded(df, str(tmp_path / "s"), "grp")
    assert spark.read.parquet(str(tmp_path / "s")).where("grp = 'g.y'").count() == 2
    one = spark.createDataFrame([("k", 1, "x")], "key string, version long, body string")
    sinks.put(spark, str(tmp_path / "r"), one, ["key"])
    with pytest.raises(sinks.StaleVersion):
        sinks.put(spark, str(tmp_path / "r"), one, ["key"])
    two = spark.createDataFrame([("k", 2, "y"), ("n", 1, "z")], "key string, version long, body string")
    assert rows(sinks.put(spark, str(tmp_path / "r"), two, ["key"]), "key", "version") == [("k", 2), ("n", 1)]
    log = spark.createDataFrame([("u", 1, "a")], "unit string, at int, actor string")
    new = spark.createDataFrame([("u", 2, "a"), ("u", 3, "b"), ("w", 1, "a")], "unit string, at int, actor string")
    assert rows(sinks.append_changed(log, new, ["unit"], ["at"], ["actor"]), "unit", "at") == [("u", 3), ("w", 1)]
