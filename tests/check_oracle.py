"""Run registered queries next to their DuckDB SQL: python tests/check_oracle.py [folder] [name-part ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from millrace.session import session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(columns, rows):
    pick = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([cell(r[i]) for i in pick]) for r in rows)


QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def main(folder, parts):
    spark = session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("MILLRACE_BLOCK"):  # send every key through the plans for hot keys
        spark.conf.set("millrace.blockRows", os.environ["MILLRACE_BLOCK"])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = []
    for name, run in QUERIES.items():
        if parts and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            got = df.collect()
        except Exception as e:
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(ORACLE[name])
            cols, types = rel.columns, [str(t) for t in rel.types]
            want = rel.fetchall()
        except Exception as e:
            print(f"SQL   {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        a, b = canon(df.columns, got), canon(cols, want)
        kind = dict(zip(cols, types))
        map_ = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
        off = [f"{f.name}:{f.dataType.simpleString()}/{kind.get(f.name)}" for f in df.schema.fields
               if kind.get(f.name) in map_ and map_[kind[f.name]] != f.dataType.simpleString() or kind.get(f.name) in ("HUGEINT", None)]
        if sorted(cols) != sorted(df.columns) or a != b:
            only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
            print(f"DIFF  {name}: {sorted(df.columns)} {sorted(cols)} rows {len(a)}/{len(b)}\n   spark {only_a}\n   duck  {only_b}", flush=True)
            bad.append(name)
        else:
            print(f"ok    {name} {len(a)} {took:.1f}s {off if off else ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    main(args[0] if args else "/root/testdata/sf0.01", args[1:])
