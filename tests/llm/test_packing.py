import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import CAPACITY, best_fit, container_use, pack_lengths, pack_texts


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.sampled_from([0.5, 1.0]))
def test_every_constraint_holds(lengths, by, documents, attention):
    lengths = np.array(sorted((x for x in lengths if x * x <= attention * 100 * 100), reverse=True), dtype=np.int64)
    at = best_fit(lengths, 100, documents, attention, by=by)
    for container in set(at.tolist()):
        own = lengths[at == container]
        assert own.sum() <= 100 and len(own) <= documents and (own**2).sum() <= attention * 100 * 100 + 1e-6


def test_little_space_is_left():
    lengths = np.sort(np.random.default_rng(3).integers(1, 900, 5000))[::-1]
    containers = best_fit(lengths).max() + 1
    assert containers <= 1.01 * lengths.sum() / CAPACITY + 1


def test_parts_cover_long_texts(spark):
    items = spark.createDataFrame([("long", 5000), ("full", 2048), ("a", 1000), ("b", 904), ("none", 0), ("none", 0)], "doc_id string, n_tokens int")
    rows = pack_lengths(items).collect()
    long = sorted((r.part, r.first_token, r.n_tokens) for r in rows if r.doc_id == "long")
    assert long == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert [r.container for r in rows if r.doc_id == "none"] == [None, None]
    used = {}
    for r in rows:
        if r.container:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= CAPACITY and len(used) == 5  # 8 952 tokens
    assert len([r for r in rows if r.doc_id == "full"]) == 1


def test_shards_hold_all(spark):
    items = spark.range(3000).selectExpr("id as doc_id", "cast(1 + id % 700 as int) as n_tokens")
    rows = pack_lengths(items, shard_items=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    fill = sum(r.n_tokens for r in rows) / (CAPACITY * len({r.container for r in rows}))
    assert fill > 0.97 and len({r.container.split("-")[0] for r in rows}) == 6


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_texts(spark, by):
    rows = [(1, "word " * 3000, 7), (2, None, 7), (3, "", 7), (4, "short", 7), (4, "short", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = pack_texts(df, "doc_id", "text", by=by).collect()
    assert sorted((r.doc_id, r.part) for r in got) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (4, 0)]
    assert pack_texts(df.limit(0), "doc_id", "text").count() == 0


def test_long_items_are_alone_and_limits_reach_the_packing(spark):
    items = spark.createDataFrame([(0, 1950)] + [(i, 90) for i in range(1, 40)], "doc_id bigint, n_tokens int")
    rows = {r.doc_id: r.container for r in pack_lengths(items, documents=7, attention=0.9).collect()}
    assert [d for d, c in rows.items() if c == rows[0]] == [0]
    use = container_use(pack_lengths(items, documents=7, attention=0.9)).collect()
    assert sorted(r.n_parts for r in use) == [1, 4, 7, 7, 7, 7, 7]
    assert {r.unused for r in use if r.n_parts == 7} == {CAPACITY - 630}


def test_attention_binds_before_tokens():
    lengths = np.array([1400] * 4 + [600] * 4)
    assert best_fit(lengths, attention=1.0).max() == 3  # 2 000 tokens each
    assert best_fit(lengths, attention=0.5).max() > 3
