import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer
from tessera.operators.index import Index, build_index

PLAIN = Analyzer(remove_stopwords=False, stemming=False)
TINY = {"d1": "alpha beta beta", "d2": "alpha gamma", "d3": "beta gamma gamma gamma"}


def make(spark, docs, analyzer=PLAIN, **options):
    rows = [(i, d, t) for i, (d, t) in enumerate(docs.items())]
    return build_index(spark.createDataFrame(rows, "ord bigint, doc_id string, text string"), analyzer, **options)


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, text string")


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    make(spark, TINY).save(path)
    return Index.load(spark, path)


def ranking(df, qid="q0"):
    return {r.doc_id: r.score for r in df.where(F.col("qid") == qid).orderBy("rank").collect()}


def test_statistics(tiny):
    assert (tiny.n_docs, tiny.mean_length) == (3, 3.0)
    assert {r.doc_id: r.dl for r in tiny.docs.collect()} == {"d1": 3, "d2": 2, "d3": 4}
    assert {r.term: r.df for r in tiny.terms.collect()} == {"alpha": 2, "beta": 2, "gamma": 2}
    assert [(r.term, r.ord, r.tf) for r in tiny.postings_of(["beta", "gamma"]).orderBy("term", "ord").collect()] == [("beta", 0, 2), ("beta", 2, 1), ("gamma", 1, 1), ("gamma", 2, 3)]
    assert {r.term: r.term_id for r in tiny.term_ids().collect()} == {"alpha": 0, "beta": 1, "gamma": 2}
    assert [(r.term, r.tf) for r in tiny.forward_of([2]).collect()] == [("beta", 1), ("gamma", 3)]


def test_document_frequency_of_words(spark, tiny):
    words = spark.createDataFrame([(w,) for w in ("alpha", "delta", "alpha-beta", "")], "word string")
    assert {r.word: r.df for r in tiny.document_frequency(words).collect()} == {"alpha": 2, "delta": 0, "alpha-beta": 0, "": 0}


def test_boolean(spark, tiny):
    queries = ask(spark, "alpha beta", "beta gamma", "alpha delta", "")
    found = lambda mode: {q: sorted(r.ord for r in rows if r.qid == q) for q in ("q0", "q1", "q2", "q3") for rows in [rk.boolean_search(queries, tiny, mode).collect()]}
    assert found("and") == {"q0": [0], "q1": [2], "q2": [], "q3": []}
    assert found("OR") == {"q0": [0, 1, 2], "q1": [0, 1, 2], "q2": [0, 1], "q3": []}
    with pytest.raises(ValueError, match="xor"):
        rk.boolean_search(queries, tiny, "xor")


def test_bm25(spark, tiny):
    queries = ask(spark, "beta", "beta gamma", "zzz")
    ranked = rk.bm25(queries, tiny)
    assert ranking(ranked) == pytest.approx({"d1": math.log(1.6) * 1.375, "d3": math.log(1.6) * 0.88})
    both = ranking(ranked, "q1")
    assert list(both) == ["d3", "d1", "d2"] and both["d3"] == pytest.approx(1.102942, abs=1e-6)
    assert ranking(ranked, "q2") == {}


def test_bm25_without_saturation_or_length(spark, tiny):
    flat = ranking(rk.bm25(ask(spark, "beta"), tiny, k1=0.0))
    assert flat == pytest.approx({"d1": math.log(1.6), "d3": math.log(1.6)})
    with_length, without = (ranking(rk.bm25(ask(spark, "gamma"), tiny, b=b)) for b in (0.75, 0.0))
    assert without["d3"] > with_length["d3"] and without["d2"] < with_length["d2"]


def test_cosine(spark, tiny):
    got = ranking(rk.top_k(rk.vsm_scores(ask(spark, "beta gamma"), tiny), tiny, 10))
    assert next(iter(got)) == "d3" and got["d3"] == pytest.approx(0.981951, abs=1e-6)
    two = make(spark, {"same": "alpha beta", "other": "gamma delta"})
    assert ranking(rk.top_k(rk.vsm_scores(ask(spark, "alpha beta"), two), two, 10)) == pytest.approx({"same": 1.0})


def test_a_term_in_every_document_scores_nothing_by_cosine_but_not_by_bm25(spark):
    two = make(spark, {"a": "x y", "b": "x z"})
    assert rk.vsm_scores(ask(spark, "x"), two).count() == 0
    assert all(r.idf >= 0 for r in two.terms.select(rk.bm25_idf(two).alias("idf")).collect())


def test_forward_index_keeps_the_most_frequent_then_the_first(spark):
    index = make(spark, {"d": "a a a b b c d e"}, forward_terms=4)
    assert [(r.term, r.tf) for r in index.forward.orderBy("rank").collect()] == [("a", 3), ("b", 2), ("c", 1), ("d", 1)]


def test_rm3_expands_to_a_distribution(spark, tiny):
    weights = rk.query_weights(ask(spark, "beta", "zzz"), tiny)
    model = rk.relevance_model(rk.feedback_weights(rk.bm25_scores(weights, tiny), tiny, 2), tiny)
    expanded = rk.expanded_queries(weights, rk.expansion_terms(model, tiny, 5, 0.0), 0.5).collect()
    assert {"beta", "gamma"} <= {r.term for r in expanded} and {r.qid for r in expanded} == {"q0"}
    assert sum(r.weight for r in expanded) == pytest.approx(1)


def test_rm3_falls_back_to_the_first_pass(spark, tiny):
    queries = ask(spark, "beta")
    none = rk.rm3(queries, tiny, min_idf=99.0)
    assert not any(r.expanded for r in none.collect())
    assert ranking(none) == pytest.approx(ranking(rk.bm25(queries, tiny, k1=1.5)))


def test_empty_and_stopword_documents_stay_in_the_index(spark):
    index = make(spark, {"empty": "", "stops": "the of and to", "real": "vaccine trial", "null": None}, Analyzer())
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {"empty": 0, "stops": 0, "real": 2, "null": 0}
    assert index.mean_length == 0.5
    assert list(ranking(rk.bm25(ask(spark, "vaccines", "the of"), index))) == ["real"]


@pytest.mark.parametrize("k", [0, 1, 5, 10, 100])
def test_ties_go_to_the_earlier_document(spark, k):
    index = make(spark, {f"d{i:02}": "same words" for i in range(50)})
    assert list(ranking(rk.bm25(ask(spark, "same"), index, k))) == [f"d{i:02}" for i in range(min(k, 50))]


def test_filling(spark, tiny):
    filled = rk.retrieve(ask(spark, "alpha", "zzz"), tiny, k=3)
    assert list(ranking(filled)) == ["d2", "d1", "d3"]
    rest = ranking(filled, "q1")
    assert list(rest) == ["d3", "d1", "d2"] and rest == pytest.approx({"d3": 1e-6, "d1": 1e-6 - 1e-9, "d2": 1e-6 - 2e-9})
    first = ranking(filled)
    assert first["d3"] == pytest.approx(first["d1"] * 1e-6)  # place 0 of the longest


def test_dispatch(spark, tiny):
    queries = ask(spark, "beta gamma")
    plain = ranking(rk.retrieve(queries, tiny, scorer="anything", fill=False))
    assert plain == pytest.approx(ranking(rk.bm25(queries, tiny, k1=1.5)))
    assert ranking(rk.retrieve(queries, tiny, scorer="vsm", fill=False))["d3"] == pytest.approx(0.981951, abs=1e-6)
    assert rk.retrieve(queries, tiny, scorer="custom", use_rm3=True, fill=False).count() == 3


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="repeated"):
        build_index(spark.createDataFrame([(0, "a", "x"), (1, "a", "y")], "ord bigint, doc_id string, text string"))
    with pytest.raises(ValueError, match="line break"):
        make(spark, {"bad\nid": "x"}).save(str(tmp_path / "i"))
    run = spark.createDataFrame([("q", "d", 1), ("q", "d", 2)], "qid string, doc_id string, rank int")
    with pytest.raises(ValueError, match="documents"):
        rk.checked_run(run, 10)
    with pytest.raises(ValueError, match="at most"):
        rk.checked_run(run.limit(1), 0)


def test_another_format_is_refused(spark, tmp_path):
    path = str(tmp_path / "i")
    make(spark, TINY).save(path)
    spark.createDataFrame([('{"version": 0}',)], "value string").write.mode("overwrite").text(path + "/meta")
    with pytest.raises(ValueError, match="format"):
        Index.load(spark, path)


def test_an_empty_collection(spark):
    index = build_index(spark.createDataFrame([], "ord bigint, doc_id string, text string"))
    assert (index.n_docs, index.mean_length, index.length_unit) == (0, 0.0, 1.0)
    assert rk.retrieve(ask(spark, "x"), index).count() == 0


def test_lookups_reach_the_scan_as_filters(spark, tiny, capsys):
    tiny.postings_of(["beta"]).explain("formatted")
    assert "PushedFilters: [In(term" in capsys.readouterr().out.replace("EqualTo(term", "In(term").replace("IsNotNull(term), ", "")


def test_top_k_limits_before_the_shuffle(spark, tiny, capsys):
    rk.bm25(ask(spark, "beta"), tiny).explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out
