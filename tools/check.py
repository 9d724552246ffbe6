"""Run registered queries beside their SQL twins: python tools/check.py SF_DIR [name-part ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotelens.plans import ORACLES, QUERIES  # noqa: E402
from quotelens.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}" if v != v or abs(v) > 1e15 else repr(round(v, 6) + 0.0)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return str({k: norm(x) for k, x in v.asDict().items()})
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def main():
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(name == p or name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
            ts = time.time() - t
            cols = sorted(df.columns)
            if name not in ORACLES:
                print(f"rows {name} {len(rows)} {ts:.1f}s", flush=True)
                if not rows:
                    bad.append(name)
                continue
            t = time.time()
            rel = con.sql(ORACLES[name])
            ocols = rel.columns
            orows = rel.fetchall()
            to = time.time() - t
            a = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
            ix = [ocols.index(c) for c in cols] if sorted(ocols) == cols else None
            if ix is None:
                print(f"COLS {name} {cols} {sorted(ocols)}", flush=True)
                bad.append(name)
                continue
            b = sorted(tuple(norm(r[i]) for i in ix) for r in orows)
            if a == b:
                types = {c: t for c, t in df.dtypes}
                print(f"ok   {name} {len(a)} spark {ts:.1f}s duck {to:.1f}s" + ("" if a else "  EMPTY"), flush=True)
            else:
                bad.append(name)
                sa, sb = set(a), set(b)
                print(f"DIFF {name} spark {len(a)} duck {len(b)} cols {cols}", flush=True)
                print("   only spark", sorted(sa - sb)[:3], "\n   only duck ", sorted(sb - sa)[:3], flush=True)
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
