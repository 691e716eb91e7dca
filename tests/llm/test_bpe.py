import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import TOKENIZERS, VOCABULARY, encode_texts, encoder, merge_piece

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def own(text):
    return encoder(f"{TOKENIZERS}/{VOCABULARY}").encode(text)


@pytest.mark.parametrize("text", ["Hello world", "it's  we'll\r\n\n x", "naïve café 🎻🎻 Привет 日本語", "<|endoftext|> a", "\x00​﻿  ", " " * 300, "ab" * 3000 + "x" * 5000, "1234567890 3.14", "   lead\ttab\t"])
def test_known_texts(known, text):
    assert own(text) == known(text)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_any_text(known, text):
    assert own(text) == known(text)


def test_merges_take_the_leftmost_of_the_lowest_rank():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4, b"aaaa": 5}
    assert merge_piece(b"aaab", ranks) == [2, 3]
    assert merge_piece(b"aaaab", ranks) == [2, 4]  # aab goes before aaaa
    assert merge_piece(b"aaaa", ranks) == [5]
    assert merge_piece(b"b", ranks) == [1] and merge_piece(b"ba", ranks) == [1, 0]


def test_rows_map_one_to_one(spark, known):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, "x"), (3, "", "x"), (None, "y", "x"), (4, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "id bigint, t string, ids string")
    got = sorted(((r.id or 0, r.ids) for r in encode_texts(df, "id", "t").collect()), key=lambda x: x[0])
    assert got == [(i or 0, known(t) if t else []) for i, t, _ in [rows[4], *rows[:4], rows[5]]]
    counts = encode_texts(df, "id", "t", counts_only=True)
    assert counts.columns == ["id", "n_tokens"] and sorted(r.n_tokens for r in counts.collect()) == sorted(len(ids) for _, ids in got)
    assert encode_texts(df.limit(0), "id", "t").count() == 0


def test_ids_decode_to_the_text():
    with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as file:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    text = "Round trips, whatever the bytes: é 🎻\r\n\t"
    assert b"".join(back[i] for i in own(text)).decode() == text
