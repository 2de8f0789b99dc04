"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python tests/compare.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def session(cpus="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - began
    if sql is None:
        return None, f"{len(got)} rows, no SQL", spent
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}", spent
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if (t, types[n]) in (("int", "BIGINT"), ("bigint", "INTEGER"), ("bigint", "HUGEINT"), ("double", "HUGEINT"), ("bigint", "DOUBLE"), ("double", "BIGINT"))
           or "DECIMAL" in types[n] or "decimal" in t]
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    note = f"{len(a)} rows" + (f" types {odd}" if odd else "")
    if a == b:
        return True, note, spent
    extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return False, f"{len(a)} against {len(b)} rows; only Spark {extra}; only SQL {missing}", spent


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    from cuetable.checks.registry import collect
    queries, sqls = collect("QUERIES"), collect("SQL")
    wanted = args[1:]
    if wanted and wanted[0].startswith("@"):
        from importlib import import_module
        module = import_module(f"cuetable.checks.{wanted[0][1:]}")
        queries, sqls, wanted = module.QUERIES, module.SQL, wanted[1:]
    spark, con = session(), duck(sf_dir)
    failed = []
    for name, query in queries.items():
        if wanted and not any(w == name or w in name for w in wanted):
            continue
        try:
            ok, note, spent = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note, spent = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:32s} {spent:6.2f}s {note}", flush=True)
        if ok is False:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
