"""Rankings in tasks that hold their documents whole."""

import re

import pytest

from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer
from tessera.operators.index import build_index
from tessera.plans import catalog

PLAIN = Analyzer(remove_stopwords=False, stemming=False)
NAMES = [
    "bm25_top10", "boolean_and", "boolean_or", "beats_baseline", "fill_to_k", "trec_run_lines", "bm25_b_zero", "bm25_k1_zero", "bm25_title2_top10",
    "rm3_expanded_query", "rm3_top10", "error_analysis_per_query", "model_comparison", "sweep_b", "sweep_k1", "rm3_regressions", "rm3_worst_topics",
    "grid_best", "rm3_cv_folds", "rm3_robust_pick", "cross_dataset_table", "cross_dataset_summary", "rm3_feedback_weights", "rm3_relevance_model",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_scored_postings_never_move(spark, tables, monkeypatch, name):
    def refused(*_):
        raise AssertionError("scored postings as rows")

    monkeypatch.setattr(rk, "matching_postings", refused)  # slices of queries, united, were shuffled by query and document
    assert not re.search(r"hashpartitioning\([^)]*qid#[^)]*, ord#", plan(catalog.queries()[name](spark, tables)))


@pytest.mark.parametrize("rows", [200, 3000])
def test_slices_of_a_ranking_and_alike_queries(spark, tables, monkeypatch, rows):
    index, asked = catalog.index_of(spark, tables), catalog.topics(spark, tables)
    asked = asked.unionByName(asked.selectExpr("concat(qid, 'x') as qid", "upper(text) as text"))
    ranked = lambda df: sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())
    want = ranked(rk.top_k(rk.bm25_scores(rk.query_weights(asked, index), index), index, 10))
    monkeypatch.setattr(rk, "MERGED_ROWS", rows)
    assert ranked(rk.bm25(asked, index)) == want and want


@pytest.mark.parametrize("whole", [False, True])
def test_expansion_terms_of_whole_documents(spark, whole):
    words = [f"w{i:02}" for i in range(30)]
    rows = [(0, "a", "seed " + " ".join(words)), *((i, f"d{i}", f"x{i}") for i in range(1, 9))]
    index = build_index(spark.createDataFrame(rows, "ord bigint, doc_id string, text string"), PLAIN)
    feedback = spark.createDataFrame([("q", 0, 1.0)], "qid string, ord bigint, p double")
    model = {r.term: r.weight for r in rk.relevance_model(feedback, index, whole=whole).collect()}
    assert len(model) == (31 if whole else 24) and model["seed"] == pytest.approx(1 / 31)
