"""Run registered queries beside their SQL in DuckDB: python tools/check.py [name-prefix ...] [--sf sf0.01]."""

import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from seriesloom.plans import catalog
from seriesloom.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return "~"
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def main():
    args = [a for a in sys.argv[1:]]
    sf = "sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    folder = f"/root/testdata/{sf}"
    for m in catalog.MODULES:
        try:
            importlib.import_module(f"seriesloom.plans.{m}")
        except ModuleNotFoundError as e:
            if f"seriesloom.plans.{m}" not in str(e):
                raise
    spark = build_session("local[8]", int(os.environ.get("CHECK_PARTS", "8")), **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    names = [n for n in catalog.QUERIES if not args or any(n.startswith(a) for a in args)]
    bad = []
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            cols = sorted(df.columns)
            plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
            for word in ("CartesianProduct", "NestedLoop", "Join Cross", "ResolvedHint"):
                if word in plan:
                    print(f"PLAN {name}: {word}", flush=True)
            rows = [tuple(r[c] for c in cols) for r in df.collect()]
        except Exception as e:
            text = str(e).split("JVM stacktrace")[0].strip().splitlines()
            print(f"ERR  {name}: {type(e).__name__} " + " | ".join(text)[:900], flush=True)
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
            bad.append(name)
            continue
        took = time.time() - start
        nulls = [c for i, c in enumerate(cols) if rows and all(r[i] is None for r in rows)]
        note = f" allnull={nulls}" if nulls else ""
        if not rows:
            note += " EMPTY"
        if name not in catalog.SQL:
            print(f"ROWS {name} {len(rows)} {took:.1f}s{note} {str(rows[:2])[:200]}", flush=True)
            continue
        t1 = time.time()
        try:
            rel = con.sql(catalog.SQL[name])
            rcols = list(rel.columns)
            types = dict(zip(rcols, map(str, rel.types)))
            order = [rcols.index(c) for c in sorted(rcols)]
            want = [tuple(r[i] for i in order) for r in rel.fetchall()]
        except Exception as e:
            print(f"SQLERR {name}: {str(e)[:700]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time() - t1
        if sorted(rcols) != cols:
            print(f"COLS {name}: spark {cols} sql {sorted(rcols)}", flush=True)
            bad.append(name)
            continue
        st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "date": "DATE", "timestamp": "TIMESTAMP"}
        diff = {c: (st[c], types[c]) for c in cols if same.get(st[c], "?") != types[c]}
        if diff:
            note += f" TYPES {diff}"
        a = sorted(tuple(map(norm, r)) for r in rows)
        b = sorted(tuple(map(norm, r)) for r in want)
        if a == b:
            flag = "OK  " if not diff else "TYPE"
            if diff:
                bad.append(name)
            print(f"{flag} {name} {len(a)} {took:.1f}s sql {t2:.1f}s{note}", flush=True)
        else:
            bad.append(name)
            sa, sb = set(a), set(b)
            print(f"DIFF {name} rows {len(a)} vs {len(b)}{note}\n   cols {cols}", flush=True)
            for x in sorted(sa - sb)[:3]:
                print("   spark", str(x)[:400])
            for x in sorted(sb - sa)[:3]:
                print("   sql  ", str(x)[:400], flush=True)
    print(f"{len(names)} checked, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
