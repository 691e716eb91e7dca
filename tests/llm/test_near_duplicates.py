import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm import near_duplicates as nd
from tessera.llm.near_duplicates import CANDIDATE, CROWDED, CUT, CUT_CROWDED, NearDuplicates, Regions, components, shingles

WORDS = [f"w{i}" for i in range(4000)]


def runs(text, size):
    terms = re.findall("[a-z0-9]+", text.lower())
    return {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)}


def brute(texts, size, threshold):
    sets = {d: s for d, t in texts.items() if (s := runs(t, size))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def collection(seed, n=120):
    rng, texts = random.Random(seed), {}
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randrange(20, 60))
        texts[f"d{i:03}"] = " ".join(words)
        for c in range(rng.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(rng.randrange(0, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts[f"d{i:03}c{c}"] = " ".join(edited)
    return texts


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.5), (5, 0.8)])
def test_recall_and_precision(spark, size, threshold):
    texts = collection(size)
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {tuple(r) for r in NearDuplicates(df, "id", "t", size, threshold).pairs().collect()}
    want = brute(texts, size, threshold)
    assert got <= want and len(got) >= 0.98 * len(want) > 20


def test_copies_nulls_and_short_records(spark):
    text = "one two three four five six"
    rows = [("a", text), ("a", text.upper()), ("b", text + "!"), ("c", "  " + text), ("s1", "one two"), ("s2", "one two"), ("n", None), (None, text), ("e", ""), ("é", text)]
    found = NearDuplicates(spark.createDataFrame([(*r, "x") for r in rows], "id string, t string, key string"), "id", "t", 3, 0.5)
    assert sorted(tuple(r) for r in found.pairs().collect()) == [("a", "b"), ("a", "c"), ("a", "é"), ("b", "c"), ("b", "é"), ("c", "é")]
    star = sorted(tuple(r) for r in found.pairs(expand=2).collect())
    assert star == [("a", "b"), ("a", "c"), ("a", "é")]
    assert {r.rec_id: r.group_id for r in found.groups().collect()} == dict.fromkeys("abcé", "a")


def test_copies_of_linked_classes_are_all_paired(spark):
    one, two = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [("p", one), ("q", one), ("r", two), ("s", two)]
    found = NearDuplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t", 3, 0.5)
    assert {tuple(r) for r in found.pairs().collect()} == set(combinations("pqrs", 2))


def test_empty(spark):
    found = NearDuplicates(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert found.pairs().count() == 0 and found.groups().count() == 0


def boilerplate(n=90):
    """Records that share 57 % of their text, so two of them have a similarity of about 0.4, and some true pairs."""
    rng, shared, texts = random.Random(5), [f"b{i}" for i in range(57)], {}
    for i in range(n):
        own = [rng.choice(WORDS) for _ in range(43)]
        texts[f"d{i:03}"] = " ".join(shared + own)
        if i % 9 == 0:
            texts[f"d{i:03}x"] = " ".join(shared + own[:18] + [rng.choice(WORDS) for _ in range(25)])
    return texts


def test_nothing_is_lost_in_a_crowded_region(spark):
    texts = boilerplate()
    want = brute(texts, 3, 0.5)
    found = NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", 3, 0.5, room=4)
    assert {tuple(r) for r in found.pairs().collect()} == want and len(want) >= 9


@pytest.mark.parametrize(("size", "threshold", "common"), [(3, 0.5, 1000), (3, 0.5, 5), (5, 0.8, 5), (1, 0.6, 3)])
def test_the_exact_join_has_every_similar_pair(spark, monkeypatch, size, threshold, common):
    monkeypatch.setattr(nd, "COMMON_FROM", common)
    texts = {i: t for i, t in enumerate([*collection(1, 40).values(), *boilerplate(30).values()])}
    df = spark.createDataFrame(list(texts.items()), "num bigint, t string").select("num", F.split("t", " ").alias("terms"))
    got = {tuple(sorted(r)) for r in nd.exact_candidates(df.select("num", shingles(F.col("terms"), size).alias("shingles")), threshold).collect()}
    assert brute(texts, size, threshold) <= got and all(a != b for a, b in got)


def candidates(parts, room, window, block):
    """Pairs and crowded numbers of sorted keys that are cut into parts, as the two passes find them."""
    found, number = [], 0
    for keys in parts:
        one = Regions(True, room, window)
        num = np.arange(number, number + len(keys))
        number += len(keys)
        for i in range(0, len(keys), block):
            found += one.add(keys[i : i + block], num[i : i + block], np.zeros(len(keys[i : i + block]), bool))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        found += one.add(*none, last=True)
    rows = [r for kind, a, b in found for r in zip(kind.tolist(), a.tolist(), b.tolist())]
    again = sorted((b, a, kind == CUT_CROWDED) for kind, a, b in rows if kind in (CUT, CUT_CROWDED))
    two = Regions(False, room, window)
    for kind, a, b in two.add(*(np.array(x) for x in zip(*again)), last=True) if again else []:
        rows += zip(kind.tolist(), a.tolist(), b.tolist())
    return [(a, b) for kind, a, b in rows if kind == CANDIDATE], {a for kind, a, _ in rows if kind == CROWDED}


@given(st.lists(st.integers(0, 6), max_size=60), st.lists(st.integers(0, 60), max_size=3), st.integers(1, 7), st.integers(1, 20))
def test_regions_cut_anywhere_give_all_pairs_or_are_told_to_be_crowded(regions, cuts, room, block):
    regions = sorted(regions)
    keys = (np.array(regions, np.int64) << 24) | (np.arange(len(regions)) % 5)
    keys.sort()
    pairs, crowded = candidates(np.split(keys, sorted(c for c in cuts if c < len(keys))), room, 2, block)
    region = keys >> 24
    for value in set(region.tolist()):
        own = np.flatnonzero(region == value).tolist()
        if len(own) <= room:
            assert not crowded & set(own)
            assert sorted(p for p in pairs if p[0] in own) == list(combinations(own, 2))
        else:
            assert set(own) <= crowded
    assert all(region[a] == region[b] for a, b in pairs) and len(pairs) <= len(keys) * max(room, 2)


def test_shingles_stay_within_a_text_and_count_once(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["b", "c", "d"],), (["a", "b", "a", "b"],)], "t array<string>")
    one, two, three = (r[0] for r in df.select(shingles(F.col("t"), 2)).collect())
    assert len(one) == 3 and two == one[1:] and len(three) == 2 and three[0] == one[0]


def test_classes_and_their_links_say_everything(spark):
    one, two = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [("p", one), ("q", one), ("r", two), ("s", "other words that nobody else has")]
    found = NearDuplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t", 3, 0.5)
    assert {tuple(r) for r in found.classes().collect()} == {("p", "p", 2, 1), ("q", "p", 2, 1), ("r", "r", 1, 1), ("s", "s", 1, 0)}
    assert [tuple(r) for r in found.links.select("a", "b").collect()] == [("p", "r")]


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"c{i:02}": "c00" for i in range(21)} | dict.fromkeys("xyz", "x")
    assert components(spark.createDataFrame(edges, "a string, b string").where(F.lit(False))).count() == 0


def test_of_a_large_region_only_lookalikes_leave_and_too_many_of_them_crowd_it():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 16, (300, nd.VALUES)).astype(np.uint16)
    for i in (3, 150, 298):
        values[i + 1] = np.where(rng.random(nd.VALUES) < 0.6, values[i], values[i + 1])

    def told(values, block, cut):
        sketch, n = nd.sketches(values), len(values)
        regions, found = Regions(cut, sketched=nd.Sketched(0.5)), []
        for i in range(0, n, block):
            own = slice(i, min(n, i + block))
            size = own.stop - own.start
            found += regions.add(np.full(size, 7 << 24), np.arange(n)[own], np.zeros(size, bool), sketch=sketch[:, own])
        found += regions.add(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), last=True)
        return [(kind, a, b) for kinds, *ab in found for kind, a, b in zip(kinds.tolist(), ab[0].tolist(), ab[1].tolist())]

    for block in (300, 70):
        assert sorted(told(values, block, False)) == [(CANDIDATE, i, i + 1) for i in (3, 150, 298)]
    assert [(kind, a) for kind, a, _ in told(values, 70, True)] == [(CUT, i) for i in range(300)]
    assert sorted(told(values[:20], 20, False)) == [(CANDIDATE, 3, 4)]
    alike = np.where(rng.random((300, nd.VALUES)) < 0.8, values[0], values)
    assert sorted(told(alike, 70, False)) == [(CROWDED, i, i) for i in range(300)]


def test_parts_give_the_whole_and_intermediates_go_when_they_are_read(spark, monkeypatch):
    for name, value in (("ROWS_AT_ONCE", 0), ("SHINGLES_A_PART", 1500), ("CLASSES_A_CANDIDATE", 20)):
        monkeypatch.setattr(nd, name, value)
    names, write, mark = [], scratch.new_path, len(scratch._written)
    monkeypatch.setattr(scratch, "new_path", lambda session, name: names.append(name) or write(session, name))
    texts = boilerplate()
    found = NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t", 3, 0.5, trees=8, room=4)
    assert names.count("forest") == 2 and names.count("exact") > 1 and names.count("found") > 1
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in scratch._written[mark:]}
    assert left == {"members", "firsts", "links"}
    assert {tuple(r) for r in found.pairs().collect()} == brute(texts, 3, 0.5)
