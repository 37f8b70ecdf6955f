"""Run queries in Spark and their SQL counterpart in DuckDB and compare the rows.

python -m tests.oracle_check [folder] [query ...]
"""

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from corrobora.plans.catalogue import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def compare(spark, connection, folder, name):
    """(matches, message) for one query."""
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    if mine == theirs:
        return True, f"{sum(mine.values())} rows"
    return False, (f"rows {sum(mine.values())} / {sum(theirs.values())}\n   columns {columns}\n   only spark "
                   f"{list((mine - theirs).items())[:3]}\n   only sql {list((theirs - mine).items())[:3]}")


def main():
    from corrobora.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                ok, message = compare(spark, connection, folder, name)
            else:
                ok, message = True, f"{QUERIES[name](spark, folder).count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            ok, message = False, str(error)[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {time.time() - start:6.2f}s  {message}", flush=True)
    print(f"{len(wanted)} queries, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
