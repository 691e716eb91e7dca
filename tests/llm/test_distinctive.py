import math

import pytest

from tessera.llm.distinctive import distinctiveness


def score(tf, length, occurrences, records, mean_length):
    rate, f = occurrences / records, tf * math.log2(1 + mean_length / length)
    return (math.log2(1 + rate) + f * math.log2((1 + rate) / rate)) / (f + 1)


def test_scores_by_hand(spark):
    rows = [("a", "rare rare common", 1), ("b", "common", 2), ("c", "Common ok", 3), ("c", "common OK", 4), ("e", "", 5), ("n", None, 6), (None, "rare", 7)]
    df = spark.createDataFrame(rows, "id string, t string, term int")
    got = {(r.rec_id, r.term): r for r in distinctiveness(df, "id", "t").collect()}
    assert set(got) == {("a", "rare"), ("a", "common"), ("b", "common"), ("c", "common"), ("c", "ok")}
    row = got["a", "rare"]
    assert (row.tf, row.df) == (2, 1)
    assert row.score == pytest.approx(score(2, 3, 2, 4, 6 / 4))
    assert got["a", "common"].score == pytest.approx(score(1, 3, 3, 4, 6 / 4)) and row.score > got["a", "common"].score


def test_other_records_against_the_collection(spark):
    corpus = spark.createDataFrame([("a", "x y"), ("b", "x")], "id string, t string")
    asked = spark.createDataFrame([("q", "y unknown"), ("q", "y unknown"), ("r", None), ("s", "  ")], "qid string, text string")
    rows = distinctiveness(corpus, "id", "t", asked, "qid", "text").collect()
    assert [(r.rec_id, r.term, r.tf, r.df) for r in rows] == [("q", "y", 1, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "id string, t string")
    assert distinctiveness(none, "id", "t").count() == 0
    assert distinctiveness(none, "id", "t", spark.createDataFrame([("q", "x")], "id string, t string"), "id", "t").count() == 0
