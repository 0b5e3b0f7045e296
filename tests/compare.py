"""Run queries on Spark and their SQL on DuckDB, and compare columns, types and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from ferrywell.plans.inputs import TABLES  # noqa: E402

SPARK_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE",
    "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return value.normalize() + 0
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def _rows(rows, order) -> Counter:
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between both results; empty when they agree."""
    df = contract.queries()[name](spark, sf_dir)
    mine = df.collect()
    if name not in contract.oracle_sql():
        return [] if mine else ["no rows"]
    found = con.execute(contract.oracle_sql()[name])
    names, kinds = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    theirs = found.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    spark_kinds = {n: SPARK_NAMES.get(k, k.upper()) for n, k in df.dtypes}
    for n, kind in zip(names, kinds):
        if spark_kinds[n].replace(" ", "") != kind.replace(" ", ""):
            problems.append(f"type of {n}: {spark_kinds[n]} against {kind}")
    a = _rows(mine, [df.columns.index(n) for n in sorted(names)])
    b = _rows(theirs, [names.index(n) for n in sorted(names)])
    if a != b:
        problems.append(f"{len(mine)} rows against {len(theirs)}; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}")
    elif not mine:
        problems.append("no rows")
    return problems


def main(sf_dir: str, only: list[str]) -> int:
    from ferrywell.session import build_session

    spark, con, bad = build_session("compare", 8), duck(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in only or contract.queries():
        start = time.time()
        try:
            problems = compare(spark, con, name, sf_dir)
        except Exception as failure:  # report and go on with the next query
            problems = [f"{type(failure).__name__}: {str(failure)[:1500]}"]
        bad += bool(problems)
        kind = "sql" if name in contract.oracle_sql() else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
