"""Run registered queries against their DuckDB text: python -m tests.compare [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def rows_of(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    kinds = {c: {kind(v) for v in d} - {"null"} for c, d in zip(cols, data)}
    rows = sorted(tuple(canon(v) for v in r) for r in zip(*data)) if cols else []
    return cols, kinds, rows


def compare(spark, con, fn, sql, sf_dir):
    """Return a list of differences; empty means equal."""
    got = fn(spark, sf_dir).toArrow()
    if sql is None:
        return [] if got.num_rows > 0 else ["no rows"]
    want = con.execute(sql).to_arrow_table()
    gc, gk, gr = rows_of(got)
    wc, wk, wr = rows_of(want)
    if gc != wc:
        return [f"columns {gc} != {wc}"]
    out = []
    if not gr:
        out.append("empty result")
    if len(gr) != len(wr):
        out.append(f"rows {len(gr)} != {len(wr)}")
    for c in gc:
        if gk[c] != wk[c]:
            out.append(f"type {c}: {gk[c]} != {wk[c]}")
    if gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b]
        if bad:
            out.append(f"{len(bad)} rows differ; cols {gc}; first\n   spark {bad[0][0]}\n   duck  {bad[0][1]}")
    return out


def main(names):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from loomwright.session import local_session

    sf = "/root/testdata/sf0.01"
    if names and names[0].startswith("--sf="):
        sf = "/root/testdata/sf" + names.pop(0)[5:]
    limit = None
    if names and names[0].startswith("--limit="):
        limit = names.pop(0)[8:]
    spark, con = local_session(), duck(sf)
    if limit:
        # every group above this many rows takes the chunked forms
        spark.conf.set("spark.loomwright.groupRowLimit", limit)
    queries, oracle = entry.queries(), entry.oracle_sql()
    pick = [q for q in queries if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    failed = []
    for q in pick:
        t = time.time()
        try:
            diff = compare(spark, con, queries[q], oracle.get(q), sf)
        except Exception as err:
            lines = str(err).strip().splitlines() or [repr(err)]
            tb = [l for l in traceback.format_exc().splitlines() if "loomwright" in l or "queries" in l][-2:]
            diff = ["ERROR " + " ".join(lines)[:600] + " | " + " ".join(tb)]
        mark = "ok  " if not diff else "FAIL"
        if diff or time.time() - t > 6 or "-v" in sys.argv:
            print(f"{mark} {q:28s} {time.time()-t:6.2f}s {'' if q in oracle else '(rows only)'}", *diff, sep="\n     " if diff else " ", flush=True)
        if diff:
            failed.append(q)
    print(f"{len(pick) - len(failed)}/{len(pick)} ok; failed: {failed}")


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if a != "-v"])
