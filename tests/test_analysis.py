import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.porter import shape, stem
from tessera.functions.text import STOPWORDS, boost_title, tokenize
from tessera.operators.analysis import Analyzer, analyze


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_tokens_split_at_anything_but_ascii_letters_and_digits(spark):
    got = column(spark, ["SARS-CoV2, and COVID-19!", "İstanbul Kelvin café ß", "", None], tokenize)
    assert got == [["sars", "cov2", "and", "covid", "19"], ["i", "stanbul", "kelvin", "caf"], [], None]


def test_title_is_repeated(spark):
    long = "x" * 119 + "yz tail"
    texts = ["Cats purr. Dogs bark.", long, ". no title", "one two"]
    got = column(spark, texts, lambda c: boost_title(c, 3))
    assert got[0] == "Cats purr. Dogs bark. Cats purr Cats purr"
    assert got[1] == long + 2 * (" " + long[:120])  # cut within a word
    assert got[2] == ". no title"
    assert column(spark, texts, lambda c: boost_title(c, 1)) == texts


@pytest.mark.parametrize(
    ("words", "stems"),
    [
        ("vaccine vaccines connect connected connecting", "vaccin vaccin connect connect connect"),
        ("ponies caresses agreed hopping relational is", "poni caress agre hop relat is"),
        ("coization 1990s feed filing happy controll adoption lion", "coizat 1990 feed file happi control adopt lion"),
        ("generalization hopefulness triplicate sky conflated", "gener hope triplic sky conflat"),
    ],
)
def test_stems(words, stems):
    assert [stem(w) for w in words.split()] == stems.split()


def test_y_is_a_vowel_only_after_a_consonant():
    assert shape("syzygy") == "cvcvcv"
    assert shape("yt") == "cc"
    assert shape("yyt") == "cvc"
    assert shape("a1y") == "vcv"


@given(st.text("abcdeilnostuvyz019", max_size=14))
def test_a_stem_is_no_longer_than_its_word_but_for_a_restored_e(word):
    out = stem(word)
    assert len(out) <= max(len(word), 1) and (len(word) > 2 or out == word)


def test_stopwords_go_before_stemming_and_order_stays(spark):
    df = spark.createDataFrame([("q", "What is the origin of COVID-19 vaccines"), ("n", None), ("s", "the of and")], "id string, t string")
    rows = analyze(df, "id", "t").orderBy("pos").collect()
    assert [(r.id, r.term) for r in rows] == [("q", "origin"), ("q", "covid"), ("q", "19"), ("q", "vaccin")]
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 127


def test_analyzer_switches(spark):
    df = spark.createDataFrame([("q", "the cats cats")], "id string, t string")
    rows = analyze(df, "id", "t", Analyzer(remove_stopwords=False, stemming=False)).orderBy("pos").collect()
    assert [r.term for r in rows] == ["the", "cats", "cats"]
