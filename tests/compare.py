"""Run registered queries and their SQL side by side: ``python -m tests.compare <sf_dir> [name...]``."""

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def engine(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, sf, name, query, sql):
    """None when equal, otherwise what differs."""
    df = query(spark, sf)
    got, names = table([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    want, expected = table(result.fetchall(), [d[0] for d in result.description])
    if names != expected:
        return f"columns {names} != {expected}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lacking}"
    if not got:
        return "equal but empty"
    odd = {f: (t, kinds[f]) for f, t in df.dtypes if KINDS.get(t) != kinds[f]}
    return f"types {odd}" if odd else None


def main():
    from fleetlens.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf, picked = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = engine(sf), oracle_sql(), 0
    for name, query in queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, sf, name, query, sqls.get(name))
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__} {str(err)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
