"""Compare a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def views(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def differences(c, df, sql, tmp):
    df.write.mode("overwrite").parquet(tmp)
    c.execute(f"create or replace temp table want as {sql}")
    c.execute(f"create or replace temp table got as select * from '{tmp}/*.parquet'")
    w, g = (sorted(x[0] for x in c.execute(f"describe {t}").fetchall()) for t in ("want", "got"))
    assert w == g
    cols = ", ".join(w)
    one = lambda a, b: c.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchone()[0]
    return one("want", "got") + one("got", "want")
