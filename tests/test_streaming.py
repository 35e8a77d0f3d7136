import json

from weftline.operators.aggregates import changes_only as batch_changes
from weftline.streaming import ledger as L


def run(q):
    q.processAllAvailable()
    q.stop()


def test_change_only_stream_matches_batch(spark, tmp_path):
    rows = [("e", f"u{i % 3}", f"a{(i // 5) % 2}", "x", f"2025-01-01T00:00:{i:02}") for i in range(40)]
    src = tmp_path / "in"
    src.mkdir()
    for n in range(4):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("event", "unit", "actor", "evidence", "at"), r))) for r in rows[n * 10 : n * 10 + 10]) + "\n{bad\n")
    s = L.changes_only(L.read_ledger(spark, str(src)), ["event", "unit"], "at", ["actor", "evidence"])
    run(s.writeStream.outputMode("append").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start())
    got = sorted(map(tuple, spark.sql("select event, unit, actor, at from kept").collect()))
    batch = spark.read.schema(L.ledger_schema()).json(str(src)).where("unit is not null")
    want = sorted(map(tuple, batch_changes(batch, ["event", "unit"], ["at"], ["actor", "evidence"]).select("event", "unit", "actor", "at").collect()))
    assert got == want and len(got) > 5


def test_latest_windows_and_fan_out(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    run(L.latest_by_key(stream, ["user_id"], ["ts", "event_id"], ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("latest").start())
    assert spark.sql("select * from latest").count() == e.select("user_id").distinct().count()
    run(L.windowed_counts(stream, "ts", ["event_type"], "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").start())
    assert spark.sql("select sum(n) from windows").first()[0] == e.count()
    seen = []
    L.fan_out(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck")).awaitTermination(60)
    assert sum(n for _, n in seen) == e.count()


def test_leases(spark):
    df = spark.createDataFrame([("a", None), ("b", "not a time"), ("c", "2020-01-01"), ("d", "2030-01-01")], "unit string, expires string")
    assert sorted(r["unit"] for r in L.active_leases(df, "2025-01-01").collect()) == ["a", "b", "d"]
