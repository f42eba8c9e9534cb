"""Run registered queries on Spark and their statements on DuckDB, and compare all rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from pagemill.session import build_session


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")
    return db


def difference(name: str, frame, db) -> str | None:
    """First difference between the two results, or None."""
    expected = db.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} against {names}"
    kinds = dict(zip(names, (str(d[1]) for d in expected.description)))
    want, got = rows_of(names, expected.fetchall()), rows_of(frame.columns, frame.collect())
    if len(want) != len(got):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else ""
        missing = [r for r in want if r not in set(got)][:2] if len(want) < 5000 else ""
        return f"{len(got)} rows against {len(want)}; extra {extra}; missing {missing}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}"
    spark_kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    alike = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = {n: (k, kinds[n]) for n, k in spark_kinds.items() if alike.get(k) != kinds[n]}
    return f"types {off}" if off else None


def main(folder: str, names: list[str]) -> None:
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in names or list(QUERIES):
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            if name not in ORACLES:
                print(f"{name}: {frame.count()} rows, no SQL", flush=True)
                continue
            wrong = difference(name, frame, db)
        except Exception as error:  # report and go on with the next query
            wrong = f"{type(error).__name__} {str(error)[:1200]}"
        print(f"{name}: {'ok' if wrong is None else 'DIFFERS ' + wrong[:1500]} {time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
