"""The queries of the package on the smallest tables, against SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries as q


@pytest.fixture(scope="module")
def engine(tables):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, tables, engine, name):
    df = q.queries()[name](spark, tables)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if name in q.oracle_sql():
        relation = engine.sql(q.oracle_sql()[name])
        at = [relation.columns.index(c) for c in sorted(df.columns)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p1_found", ["qid", "run_tag", "doc_id"]), ("p2_found", ["term", "mark"]), ("p3_found", ["qid", "doc_id"]), ("p4_found", ["doc_id"]),
     ("p5_found", ["doc_id_a", "doc_id_b"]), ("p6_found", ["rec_kind", "rec_id", "term"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "subject"])],
)
def test_columns(spark, tables, name, columns):
    assert q.queries()[name](spark, tables).columns == columns


def test_all_scores_go_beyond_five_terms(spark, tables):
    counts = [r["count"] for r in q.queries()["p6_all_scores"](spark, tables).groupBy("rec_kind", "rec_id").count().collect()]
    assert max(counts) > 5
