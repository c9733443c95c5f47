"""Compare registered queries with their SQL: python tests/oracle_check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

ORACLE, QUERIES = entry.oracle_sql(), entry.queries()

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "FLOAT": "float"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    types = dict((c[0], TYPES.get(str(c[1]), str(c[1]))) for c in res.description)
    other = {c: (t, types.get(c)) for c, t in df.dtypes if t != types.get(c)}
    if other:
        print("     types differ", name, other, flush=True)
    want = rows([c[0] for c in res.description], res.fetchall())
    return got, want


if __name__ == "__main__":
    from ionweave.session import builder

    spark = (builder().master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or ORACLE:
        t = time.time()
        try:
            got, want = compare(spark, con, sys.argv[1], name)
            same = got == want
            print("ok  " if same else "DIFF", name, len(got[1]), len(want[1]), round(time.time() - t, 1), flush=True)
            if not same:
                print(got[0], want[0])
                a, b = set(got[1]), set(want[1])
                print("  only spark", len(a - b), sorted(a - b, key=repr)[:3], "\n  only sql  ", len(b - a), sorted(b - a, key=repr)[:3], flush=True)
        except Exception as e:
            print("FAIL", name, str(e)[:600], flush=True)
