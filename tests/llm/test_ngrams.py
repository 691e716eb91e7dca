import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.ngrams import block_counts, common_prefixes, marked_counts, ngram_counts, suffix_order, suffix_ranks


def brute(texts, max_n):
    occurrences, records = Counter(), Counter()
    for text in texts:
        terms = re.findall("[a-z0-9]+", text.lower())
        grams = [(n, " ".join(terms[i : i + n])) for n in range(1, max_n + 1) for i in range(len(terms) - n + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    return {g: (c, records[g]) for g, c in occurrences.items()}


@settings(deadline=None)
@given(st.lists(st.text("ab. C", max_size=25), max_size=12), st.integers(1, 4))
def test_blocks_count_as_brute_force(texts, max_n):
    batch = block_counts(texts, max_n).to_pydict()
    got = {(n, g): (o, r) for n, g, o, r in zip(*(batch[c] for c in ("n", "ngram", "n_occurrences", "n_records")), strict=True)}
    assert got == brute(texts, max_n)


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=20), max_size=6))
def test_suffixes_are_sorted_to_their_ends_and_prefixes_are_whole(records):
    code = np.array([c for r in records for c in r], np.int64)
    rest = np.array([len(r) - i for r in records for i in range(len(r))], np.int64)
    suffixes = [code[i : i + n].tolist() for i, n in enumerate(rest)]
    if not suffixes:
        return
    ranks = suffix_ranks(code, rest)
    order = suffix_order(ranks)
    assert order.tolist() == sorted(range(len(code)), key=lambda i: (suffixes[i], i))
    shared = common_prefixes(ranks, rest, order).tolist()
    for i in range(1, len(order)):
        a, b = suffixes[order[i - 1]], suffixes[order[i]]
        assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("block_terms", [1, 50, 1 << 20])
def test_counts_add_up_over_blocks(spark, block_terms):
    texts = ["the cat sat on the mat", "The CAT!", "", "  ", "dog " * 30, "the\r\ncat sat"]
    rows = [(f"r{i}", t, 1) for i, t in enumerate(texts)] + [("r0", "THE cat  sat on the mat", 2), ("r9", None, 3), (None, "lost words", 4)]
    df = spark.createDataFrame(rows, "doc string, body string, n int")
    got = {(r.n, r.ngram): (r.n_occurrences, r.n_records) for r in ngram_counts(df, "doc", "body", 3, block_terms).collect()}
    assert got == brute(texts, 3)


def test_marks(spark):
    rows = [(f"r{i}", "all some" if i < 3 else "all") for i in range(7)] + [("e", ""), ("b", " "), ("n", None)]
    got = {r.ngram: r.mark for r in marked_counts(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    assert got == {"all": "common", "some": "common"}  # 3 of 9 texts are above 30 %
    rows += [(f"x{i}", "") for i in range(2)]
    got = {r.ngram: r.mark for r in marked_counts(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    assert got == {"all": "common", "some": None}


def test_empty_table(spark):
    assert marked_counts(spark.createDataFrame([], "id string, t string"), "id", "t", 2).count() == 0
