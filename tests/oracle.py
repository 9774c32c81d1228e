"""Side-by-side run of registered queries and their SQL; also a command: ``oracle.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from tidemark.plans.inputs import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(f"{v:.10g}"))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def family(t: str) -> str:
    t = t.lower()
    for names, kind in ((("bigint", "int", "integer", "smallint", "long", "hugeint"), "int"), (("double", "float"), "float"),
                        (("varchar", "string"), "text"), (("boolean",), "bool")):
        if t in names:
            return kind if t != "hugeint" else "hugeint"
    return "ts" if t.startswith("timestamp") else t


def compare(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    their_columns = [d[0] for d in result.description]
    their_types = {d[0]: family(str(d[1])) for d in result.description}
    theirs = result.fetchall()
    ours = [tuple(r) for r in df.collect()]
    problems = []
    oc, orows = normal(df.columns, ours)
    tc, trows = normal(their_columns, theirs)
    if oc != tc:
        return [f"columns {oc} != {tc}"]
    mine = {n: family(t) for n, t in df.dtypes}
    problems += [f"type of {c}: {mine[c]} != {their_types[c]}" for c in oc if mine[c] != their_types[c]]
    if len(orows) != len(trows):
        problems.append(f"rows {len(orows)} != {len(trows)}")
    if orows != trows:
        a, b = set(orows), set(trows)
        problems.append(f"values: only ours {sorted(a - b)[:3]} only theirs {sorted(b - a)[:3]}")
    return problems


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as driver
    from tidemark.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[2:] or list(driver.queries())
    bad = []
    for name in wanted:
        start = time.time()
        try:
            df = driver.queries()[name](spark, sf_dir)
            sql = driver.oracle_sql().get(name)
            problems = compare(df, con, sql) if sql else [] if df.collect() is not None else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.1f}s" + "".join(f"\n    {p}" for p in problems), flush=True)
        if problems:
            bad.append(name)
    print(f"{len(wanted) - len(bad)}/{len(wanted)} agree; bad: {bad}")


if __name__ == "__main__":
    main()
