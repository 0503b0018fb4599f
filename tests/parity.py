"""Compare every registered query with its SQL on DuckDB.

``python tests/parity.py [sf] [name-part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    dc, dr = _rows([d[0] for d in rel.description], rel.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}; spark {sr[:2]} sql {dr[:2]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)}/{len(sr)} rows differ, first spark {bad[0][0]} sql {bad[0][1]}"
    if any(type(x) is not type(y) for a, b in zip(sr[:50], dr[:50]) for x, y in zip(a, b)):
        return "types differ"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from voxelspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    parts = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            note = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        if note.startswith(("DIFF", "FAIL")):
            failed.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
