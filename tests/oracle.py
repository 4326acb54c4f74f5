"""Run registered queries next to their oracle SQL and compare whole results.

``python -m tests.oracle [sf_dir] [name …]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, bool) else int(v)) for v in row)


def compare(df, con, sql: str) -> str:
    """Empty when both results are equal, otherwise what differs."""
    want = con.sql(sql)
    kinds = dict(zip(want.columns, map(str, want.types)))
    names = sorted(df.columns)
    if names != sorted(want.columns):
        return f"columns {names} != {sorted(want.columns)}"
    wrong = {n: (k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]}
    if wrong:
        return f"types {wrong}"
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    exp = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    if len(got) != len(exp):
        return f"{len(got)} rows != {len(exp)}"
    got.sort(key=_key), exp.sort(key=_key)
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first {names} {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from tests.session import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:]
    spark, con = make_session(), connect(sf_dir)
    oracles, failures = e.oracle_sql(), 0
    for name, run in e.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                verdict = "ok" if not problem else f"FAIL {problem}"
            else:
                verdict = f"rows only ({df.count()})"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        failures += verdict.startswith(("FAIL", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
