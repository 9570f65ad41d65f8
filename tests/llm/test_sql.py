import duckdb
import pytest

import __spark_entry__
from sievedeck.llm import queries
from tests.llm.conftest import odd_rows, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(str, x[columns].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]


def test_sql_of_odd_texts(spark):
    """Nulls, empty texts and all kinds of white space, one row an id."""
    docs = table(spark, list({i: (i, t) for i, t in odd_rows() if i is not None}.values()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    made = {
        "op3_substring_dedup": queries.substrings.substring_dedup(docs).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256"),
        "op5_line_dedup": queries.lines.line_dedup(docs.select("doc_id", "text"), passages=True).selectExpr("doc_id", "n_lines", "n_removed", "sha2(cast(text as binary), 256) AS kept_sha256"),
        "op7_minhash_near_dedup": queries.neardup.near_duplicates(docs, shingle_words=4),
    }
    for name, sql in queries.oracle_sql().items():
        columns = made[name].columns
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r) for r in made[name].collect()))) == sorted(map(str, want))
