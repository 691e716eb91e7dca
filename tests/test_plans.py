"""The shapes of plans that large collections depend on."""

import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators import index as ix
from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer, counted_terms
from tessera.operators.index import build_index, first_rows, with_frequencies


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.range(300).selectExpr("id as ord", "concat('d', id) as doc_id", "concat('common word', id % 40, ' other', id) as text")
    return build_index(rows, Analyzer(remove_stopwords=False, stemming=False))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def asked(spark, *terms):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(terms)], "qid string, term string")


def test_counting_moves_no_text(spark):
    df = spark.range(10).selectExpr("id as ord", "'x y' as text")
    assert "Exchange" not in plan(counted_terms(df, ["ord"], "text", Analyzer()))


def test_a_batch_reads_the_buckets_of_its_terms_and_groups_without_a_shuffle(spark, index):
    hits = rk.matching_postings(asked(spark, "word3"), index, F.col("tf"))
    text = plan(hits.groupBy("qid", "ord").agg(F.sum("tf")))
    assert "bucket#" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "hashpartitioning(qid" not in text and "hashpartitioning(ord" not in text
    files = hits.inputFiles()
    assert 0 < sum("bucket=" in f for f in files) < len(index.postings.inputFiles())


@pytest.mark.parametrize(("rows", "work"), [(2, 4_000_000), (500_000, 10), (1, 1)])
def test_slices_of_a_batch_give_what_the_batch_gives(spark, index, monkeypatch, rows, work):
    queries = asked(spark, "common", "word3", "other7", "common", "none")
    whole = sorted(map(tuple, rk.matching_postings(queries, index, F.col("tf")).collect()))
    monkeypatch.setattr(rk, "BROADCAST_QUERY_TERMS", rows)
    monkeypatch.setattr(rk, "SCORED_PER_TASK", work)
    monkeypatch.setattr(rk, "FEW_QUERY_TERMS", 0)
    assert sorted(map(tuple, rk.matching_postings(queries, index, F.col("tf")).collect())) == whole and len(whole) == 300 + 8 + 1 + 300


@pytest.mark.parametrize(("broadcast", "hot"), [(500_000, 10), (5, 10), (0, 10), (5, 1000)])
def test_frequencies_join_alike_at_every_size(spark, index, monkeypatch, broadcast, hot):
    monkeypatch.setattr(ix, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(ix, "HOT_TERM", hot)
    rows = index.postings.select("term", "ord")
    got = with_frequencies(rows, index.terms.select("term", "df"), 341).groupBy("term").agg(F.count("*").alias("n"), F.max("df").alias("df")).collect()
    assert len(got) == 341 and all(r.n == r.df for r in got)


@pytest.mark.parametrize("few", [500_000, 0])
def test_the_first_row_of_a_key(spark, monkeypatch, few):
    monkeypatch.setattr(ix, "BROADCAST_TERMS", few)
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (5, "a", "z")], "ord bigint, id string, t string")
    assert sorted(map(tuple, first_rows(rows, "id", "ord").select("ord", "id").collect())) == [(1, "a"), (2, "b")]


def test_closing_and_scopes_free_what_was_written(spark, index):
    other = build_index(index.docs.select("ord", "doc_id", F.lit("x").alias("text")))
    assert other.folder and spark.catalog.tableExists(other.tables[0])
    other.close()
    assert not spark.catalog.tableExists(other.tables[0])
    assert not any(p.startswith(other.folder) for _, p in scratch._written)
    with scratch.scope():
        table = scratch.written(spark.range(3), "some")
        assert table.count() == 3
        mark = len(scratch._written)
    assert len(scratch._written) < mark


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session())
