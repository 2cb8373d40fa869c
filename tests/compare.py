"""Run a query and its SQL on the same tables and compare rows and types.

``python tests/compare.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewheel.sources.tables import SCHEMAS

KINDS = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def kind(spark_type: str) -> str:
    return KINDS.get(spark_type, spark_type.upper())


def compare(df, sql: str, folder: str, files: str = "") -> tuple[int, str | None]:
    """Rows in the result and what differs, if anything.

    ``files`` is the pattern of the files in a table's folder, if it is one.
    """
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet{files}'")
    found = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in found.description}
    rows = found.fetchall()
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    got = df.collect()
    types = {c: t.replace(" ", "") for c, t in theirs.items()}
    if types != ours:
        return len(got), f"types: {sorted(set(ours.items()) ^ set(types.items()))}"
    names = list(theirs)
    a = Counter(tuple(r[c] for c in names) for r in got)
    b = Counter(rows)
    if a != b:
        return len(got), f"rows {len(got)}/{len(rows)}: {list((a - b).items())[:3]} against {list((b - a).items())[:3]}"
    return len(got), None


if __name__ == "__main__":
    from tidewheel import plans
    from tidewheel.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare",
        "local[8]",
        extra={
            "spark.sql.shuffle.partitions": os.environ.get("PARTITIONS", "8"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or plans.QUERIES:
        start = time.time()
        count, wrong = compare(plans.QUERIES[name](spark, folder), plans.ORACLES[name], folder)
        print(f"{'FAIL' if wrong else 'ok'} {name} {count} rows {time.time() - start:.2f}s {wrong or ''}", flush=True)
