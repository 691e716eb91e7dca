import pytest

from tessera.llm.quality import PROFILES, text_statistics, text_structure, unlike_prose

PROSE = "The cat sat on the mat and looked at the rain that fell over the garden. It was not pleased, but there was nothing it could do about it."
LIST = "- red apples\n- green pears\n- ripe plums\n- sweet cherries\n- dried figs\n- fresh lemons"
TABLE = "| name | size | cost |\n|---|---|---|\n| bolt | 12 | 3.50 |\n| nut | 14 | 2.75 |\n| screw | 9 | 1.20 |"
JUNK = "}{[]=+%%$#@!~ ^^&&**|\\/<>{}{}[]=+%%$#@!~ ^^&&**|\\/<>"
NUMBERS = "12 33, 44% 95 71/ 88 103, 4 17% 66 29 81/ 40 55, 63 77% 90"


def structures(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.structure for r in text_structure(df, "i", "t").orderBy("i").collect()]


def test_structures(spark):
    assert structures(spark, PROSE, LIST, TABLE, JUNK, NUMBERS) == ["prose", "list", "table", "junk", "junk"]


def test_prose_stays_prose(spark):
    assert structures(spark, PROSE.upper(), PROSE.rstrip("."), PROSE + "\n- one\n- two", PROSE + " (Café Ærø) ***", "We found a cat on the mat.") == ["prose"] * 5


def test_counts(spark):
    df = spark.createDataFrame([("a", "Hi, big World!\r\n\r\nnext line\n  \nlast.", 1)], "id string, t string, n_words int")
    r = text_statistics(df, "id", "t").first()
    assert (r.n_words, r.n_lines, r.n_chars) == (6, 3, 37 - 1)
    assert r.mean_word_length == pytest.approx(22 / 6)
    assert r.symbol_ratio == pytest.approx(3 / 36) and r.end_punctuation_ratio == pytest.approx(2 / 3)
    assert sum(r[c] for c in r.asDict() if c.startswith("c_")) == pytest.approx(1)
    assert sum(r[c] for c in r.asDict() if c.startswith("w_")) == pytest.approx(1)


def test_null_empty_blank_and_long(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \t\n"), (3, PROSE * 2000)], "i int, t string")
    rows = text_structure(df, "i", "t").orderBy("i").collect()
    assert [r.structure for r in rows] == [None, None, None, "prose"]
    assert rows[0].n_words is None and (rows[1].n_words, rows[1].symbol_ratio, rows[2].n_lines) == (0, 0.0, 0)


def test_cases_are_records_each_once(spark):
    rows = [("a", TABLE), ("a", TABLE.upper()), ("b", PROSE), (None, TABLE), ("c", None), ("d", "")]
    assert [r.doc for r in unlike_prose(spark.createDataFrame(rows, "doc string, t string"), "doc", "t").collect()] == ["a"]
    assert unlike_prose(spark.createDataFrame([], "doc string, t string"), "doc", "t").count() == 0


def test_profiles_are_distributions():
    for kind, words, chars in PROFILES:
        assert kind in {"prose", "list", "table", "junk"}
        assert sum(words.values()) == pytest.approx(1, abs=0.011) and sum(chars.values()) == pytest.approx(1, abs=0.011)
