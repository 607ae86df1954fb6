"""Time the DuckDB oracle statements (single-node reference point)."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopfloor import oracle  # noqa: E402
from tools.check_oracle import TABLES  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    times = {}
    for name, sql in oracle.statements().items():
        t0 = time.perf_counter()
        con.sql(sql).fetchall()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    main()
