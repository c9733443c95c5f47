"""Text queries that SQL can express, against DuckDB, and the registration of all eleven."""

import pytest
from oracle_check import compare, connect

from ionweave.llm.oracle import ORACLE
from ionweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got, want = compare(spark, con, SF, name)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_one_query_per_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_mixing_with_rates_of_several_draws(spark, tmp_path):
    import duckdb
    from oracle_check import rows

    docs = [(i, "x" * 100_000, "l", "large", 1) for i in range(60)] + [(100 + i, "tiny", "l", None, 1) for i in range(3)]
    docs += [(200, None, "l", "none", 1), (None, "y" * 10, "l", "large", 1), (100, "tiny", "l", None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op3_mixing"](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(ORACLE["op3_mixing"])
    assert got == rows([c[0] for c in res.description], res.fetchall())
    assert sum(r[2] == 101 or r[1] == 101 for r in got[1]) > 400
