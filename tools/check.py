"""Run registered queries against their SQL in DuckDB: python tools/check.py [sf] [name substring ...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from flowlens.plans import registry  # noqa: E402
from flowlens.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def kind(dtype: str) -> str:
    return {"int": "integer", "bigint": "bigint", "INTEGER": "integer", "BIGINT": "bigint", "string": "text", "VARCHAR": "text",
            "double": "double", "DOUBLE": "double"}.get(dtype, dtype)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session()
    registry.load()
    bad = []
    for name, fn in registry.QUERIES.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            t0 = time.time()
            df = fn(spark, folder)
            got = df.toPandas()
            t1 = time.time()
            if name not in registry.ORACLES:
                print(f"rows  {name:32s} {len(got):7d} rows  spark {t1 - t0:6.2f}s", flush=True)
                if len(wanted) > 0:
                    print(got.head(5).to_string())
                continue
            rel = con.execute(registry.ORACLES[name])
            types_want = {d[0]: str(d[1]) for d in rel.description}
            want = rel.fetchdf()
            t2 = time.time()
            types_got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            cols = sorted(got.columns)
            note = ""
            if cols != sorted(want.columns):
                note = f"columns {cols} != {sorted(want.columns)}"
            elif len(got) != len(want):
                note = f"rows {len(got)} != {len(want)}"
            else:
                diff = [f"{c}: {types_got[c]} vs {types_want[c]}" for c in cols if kind(types_got[c]) != kind(types_want[c])]
                a, b = got[cols].astype(object), want[cols].astype(object)
                a, b = a.where(~a.isna(), None), b.where(~b.isna(), None)
                ra = sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in a.itertuples(index=False))))
                rb = sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in b.itertuples(index=False))))
                if ra != rb and not diff:
                    only = [(x, y) for x, y in zip(ra, rb) if x != y]
                    note = f"{len(only)} of {len(ra)} rows differ, first:\n   spark {only[0][0]}\n   sql   {only[0][1]}"
                elif diff:
                    note = "types " + "; ".join(diff)
            state = "FAIL " if note else "ok   "
            print(f"{state} {name:32s} {len(got):7d} rows  spark {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s  {note}", flush=True)
            if note:
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            if wanted:
                traceback.print_exc(limit=6)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    pd.set_option("display.width", 200)
    main()
