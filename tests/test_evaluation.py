import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev


def run_of(spark, *docs, qid="q"):
    return spark.createDataFrame([(qid, d, i) for i, d in enumerate(docs, 1)], "qid string, doc_id string, rank int")


def qrels_of(spark, qid="q", **grades):
    return spark.createDataFrame([(qid, d, g) for d, g in grades.items()], "qid string, doc_id string, rel int")


def metrics(spark, docs, grades, k=10):
    return ev.per_query_metrics(run_of(spark, *docs), qrels_of(spark, **grades), k).first()


def test_the_ideal_order_has_ndcg_1(spark):
    assert metrics(spark, ["d1", "d2", "d3", "d4"], dict(d1=3, d2=2, d3=1, d4=0)).ndcg_10 == pytest.approx(1)


def test_unjudged_documents_earn_nothing(spark):
    row = metrics(spark, ["x", "y"], dict(d1=3))
    assert (row.ndcg_10, row.map_10, row.mrr, row.p_k, row.num_ranked) == (0, 0, 0, 0, 2)


def test_ndcg_by_hand(spark):
    assert metrics(spark, ["a", "b", "c"], dict(a=2, b=0, c=1)).ndcg_10 == pytest.approx(3.5 / (3 + 1 / math.log2(3)))


def test_a_negative_grade_costs(spark):
    row = metrics(spark, ["b", "a"], dict(a=1, b=-1))
    assert row.ndcg_10 == pytest.approx((-0.5 + 1 / math.log2(3)) / (1 - 0.5 / math.log2(3)))


def test_average_precision(spark):
    assert metrics(spark, ["a", "x", "b"], dict(a=1, b=1)).map_10 == pytest.approx((1 + 2 / 3) / 2)
    assert metrics(spark, ["a"], dict(a=0)).map_10 == 0
    docs = [f"r{i}" if i in (1, 5, 10, 11) else f"x{i}" for i in range(1, 12)]
    grades = {f"r{i}": 1 for i in (1, 5, 10, 11)} | {f"other{i}": 1 for i in range(11)}
    assert metrics(spark, docs, grades).map_10 == pytest.approx(1.7 / 15)


def test_reciprocal_rank_has_no_cut(spark):
    assert metrics(spark, ["x", "y", "a"], dict(a=1)).mrr == pytest.approx(1 / 3)
    assert metrics(spark, [f"x{i}" for i in range(19)] + ["a"], dict(a=1)).mrr == pytest.approx(1 / 20)


@pytest.mark.parametrize(("k", "want"), [(2, 0.5), (4, 0.5), (0, 0.0), (8, 0.25)])
def test_precision_divides_by_k(spark, k, want):
    assert metrics(spark, ["a", "x", "b", "y"], dict(a=1, b=1), k).p_k == want


def test_repeated_documents_count_once(spark):
    row = metrics(spark, ["a"] * 10, dict(a=1))
    assert (row.ndcg_10, row.map_10, row.num_ranked) == (1, 1, 1)
    closed = ev.dedup_keep_first(run_of(spark, "a", "a", "b")).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in closed] == [("a", 1), ("b", 2)]


def test_missing_and_unjudged_queries(spark):
    run = run_of(spark, "a").unionByName(run_of(spark, "a", qid="extra"))
    qrels = qrels_of(spark, a=1).unionByName(qrels_of(spark, qid="unanswered", a=1))
    row = ev.evaluate_run(run, qrels).first()
    assert (row.ndcg_10, row.num_queries) == (0.5, 2)
    assert [r.qid for r in ev.skipped_queries(run, qrels).collect()] == ["extra"]
    empty = ev.evaluate_run(run.limit(0), qrels.limit(0)).first()
    assert (empty.ndcg_10, empty.num_queries) == (0.0, 0)


def test_settings_are_measured_side_by_side(spark):
    run = run_of(spark, "a", "b").withColumn("s", F.lit(1)).unionByName(run_of(spark, "b").withColumn("s", F.lit(2)))
    rows = {r.s: r for r in ev.evaluate_run(run, qrels_of(spark, a=1), by=("s",)).collect()}
    assert rows[1].mrr == 1 and rows[2].mrr == 0
    named = ev.evaluate_run(run.where("s = 1"), qrels_of(spark, a=1), by=("s",), settings=[(1,), (7,)])
    assert {r.s: r.mrr for r in named.collect()} == {1: 1.0, 7: 0.0}


@pytest.mark.parametrize(("build", "latency", "want"), [(0, 0, 0.1), (1, 1, 0.0), (4, 4, -0.3), (9, 9, -0.3), (2, 0, 0.0)])
def test_efficiency(spark, build, latency, want):
    cols = [F.lit(float(x)) for x in (build, latency, 1, 1)]
    assert spark.range(1).select(ev.efficiency_modifier(*cols)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(("own", "median", "want"), [(1, 2, 0.1), (4, 2, 0.0), (2, 2, 0.1 * 2 / 3), (5, 0, 0.0)])
def test_index_size(spark, own, median, want):
    assert spark.range(1).select(ev.index_size_score(F.lit(float(own)), F.lit(float(median)))).first()[0] == pytest.approx(want)


def test_no_median_no_modifier(spark):
    assert spark.range(1).select(ev.efficiency_modifier(*[F.lit(x) for x in (1.0, 1.0, 0.0, 0.0)])).first()[0] == 0


def test_a_baseline_must_be_beaten_strictly(spark):
    own = ev.evaluate_run(run_of(spark, "a"), qrels_of(spark, a=1))
    row = ev.summarize(own, own).first()
    assert row.provisional == pytest.approx(0.8) and not row.beats_ndcg_10 and not row.beats_map_10
