"""The queries of this subpackage against their SQL, or against brute force where there is none."""

import duckdb
import pytest

from sieveline.llm.queries import ORACLES, QUERIES
from tests.llm.test_setjoin import slow_components

TABLES = "documents pages labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert found and sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, found))


def test_partenum_over_the_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_partenum"](spark, sf).collect()), key=repr) == slow_components(docs)
