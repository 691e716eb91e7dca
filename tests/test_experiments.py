import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer
from tessera.operators.index import build_index
from tessera.plans import experiments as ex

TEXTS = ["red fox jumps", "red red fox", "blue fox sleeps long here", "green tree grows", "red tree fox tree", "blue sky over tree"]


@pytest.fixture(scope="module")
def setup(spark):
    rows = [(i, f"d{i}", t) for i, t in enumerate(TEXTS)]
    index = build_index(spark.createDataFrame(rows, "ord bigint, doc_id string, text string"), Analyzer())
    queries = spark.createDataFrame([("q1", "red fox"), ("q2", "tree"), ("q3", "sky zzz")], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d4", 1), ("q2", "d3", 1), ("q3", "d5", 1)], "qid string, doc_id string, rel int")
    return index, queries, qrels


def test_a_sweep_equals_single_runs(setup):
    index, queries, qrels = setup
    points = [(0.0, 0.75), (1.2, 0.0), (2.0, 0.6)]
    swept = {(r.k1, r.b): r.ndcg_10 for r in ex.bm25_sweep(queries, index, qrels, points).collect()}
    for k1, b in points:
        assert swept[k1, b] == pytest.approx(ev.evaluate_run(rk.bm25(queries, index, 10, k1, b), qrels).first().ndcg_10)


def test_the_rm3_grid_equals_single_runs(setup):
    index, queries, qrels = setup
    grid = ex.rm3_grid(queries, index, qrels, [1, 2], [1, 3], [0.3, 0.6]).collect()
    assert len(grid) == 2 * 2 * 2 * 3
    for docs, terms, alpha in ((1, 3, 0.3), (2, 1, 0.6), (2, 3, 0.6)):
        single = ev.per_query_metrics(rk.rm3(queries, index, 10, 2.0, 0.6, docs, terms, alpha), qrels)
        want = {r.qid: r.ndcg_10 for r in single.collect()}
        assert {r.qid: r.ndcg_10 for r in grid if (r.fb_docs, r.fb_terms, r.alpha) == (docs, terms, alpha)} == pytest.approx(want)


def table(spark, scores):
    rows = [(1, 1, a, q, s) for (a, q), s in scores.items()]
    return spark.createDataFrame(rows, "fb_docs int, fb_terms int, alpha double, qid string, ndcg_10 double")


def test_cross_validation_picks_on_the_other_folds(spark):
    per = table(spark, {(0.3, "a"): 1.0, (0.3, "b"): 0.0, (0.6, "a"): 0.0, (0.6, "b"): 0.5})
    plain = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "qid string, ndcg_10 double")
    rows = {r.fold: (r.alpha, r.held_out_ndcg, r.baseline_ndcg) for r in ex.cross_validate(per, plain, folds=2).collect()}
    assert rows == {0: (0.6, 0.0, 0.25), 1: (0.3, 0.0, 0.75)}


def test_the_robust_setting_has_the_best_worst_fold(spark):
    per = table(spark, {(0.3, "a"): 1.0, (0.3, "b"): 0.1, (0.6, "a"): 0.4, (0.6, "b"): 0.3})
    rows = {r.alpha: (r.place, r.robust, r.worst_fold) for r in ex.robust_settings(per, folds=2).collect()}
    assert rows == {0.3: (1, False, 0.1), 0.6: (2, True, 0.3)}
    assert ex.robust_settings(per, folds=2, first=1).count() == 2  # the best mean and, beyond it, the robust one


def test_cross_dataset(setup):
    index, queries, qrels = setup
    configs = [(1.2, 0.75, None, None, None), (1.2, 0.75, 2, 2, 0.5)]
    rows = ex.cross_dataset({"one": (queries, index, qrels), "two": (queries.limit(1), index, qrels)}, configs)
    summary = {r.config: r for r in ex.cross_dataset_summary(rows).collect()}
    each = [r.ndcg_10 for r in rows.where(F.col("config") == "bm25 1.2/0.75").collect()]
    assert summary["bm25 1.2/0.75"].worst_ndcg == pytest.approx(min(each)) and summary["bm25 1.2/0.75"].mean_ndcg == pytest.approx(sum(each) / 2)
    assert {r.worst_ndcg for r in ex.cross_dataset_summary(rows, left_out="two").collect()} != set()


def test_dataset_stats(setup):
    index, queries, qrels = setup
    row = ex.dataset_stats(queries, index, qrels).first()
    assert (row.docs, row.queries, row.rel_per_query) == (6, 3, 1.3)


def test_error_analysis(setup):
    index, queries, qrels = setup
    rows = {r.qid: r for r in ex.error_analysis(queries, index, qrels).collect()}
    assert set(rows) == {r.qid for r in queries.collect()} and rows["q1"].n_relevant == 2
    assert rows["q1"].query_terms == ["red", "fox"]
    assert len(rows["q1"].top_grades) == rows["q1"].unjudged + sum(1 for d in ("d1", "d4") if d)
    assert not {"red", "fox"} & set(rows["q1"].expansion)
    worst = ex.worst_queries(ex.error_analysis(queries, index, qrels), 1).first()
    assert worst.ndcg_rm3 == min(r.ndcg_rm3 for r in rows.values())


def test_best_setting_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 0.3), (0.5, 0.9, 0.3), (2.0, 0.1, 0.2)], "k1 double, b double, ndcg_10 double")
    assert ex.best_setting(rows).first().k1 == 0.5
