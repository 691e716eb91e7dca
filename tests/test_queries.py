"""Every registered query runs; those with SQL agree with another engine on the smallest tables."""

import contextlib
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog, oracle

def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


@pytest.fixture(scope="module")
def engine(tables):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows_as_sql(spark, tables, engine, name):
    df = catalog.queries()[name](spark, tables)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = engine.sql(oracle.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert own == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ndcg_at_10", "dedup_keep_first", "trec_run_roundtrip", "run_report"])
def test_every_system_comes_out(spark, tables, name):
    systems = {r.run_tag for r in catalog.run_rows(spark, tables).select("run_tag").distinct().collect()}
    assert len(systems) > 1 and {r.run_tag for r in catalog.queries()[name](spark, tables).select("run_tag").distinct().collect()} == systems


@pytest.mark.parametrize("name", ["bm25_title2_top10", "vsm_top10", "boolean_and", "rm3_top10", "ndcg_at_10"])
def test_with_generated_code(spark, tables, engine, name):
    settings = {"spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.codegen.wholeStage": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        test_same_rows_as_sql(spark, tables, engine, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_text_package_may_be_absent_or_broken(monkeypatch):
    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning) if entry.importlib.util.find_spec("tessera.llm") else contextlib.nullcontext():
        assert set(entry.queries()) == set(catalog.queries())
