import random
import statistics

import pytest

from tessera.llm.rank_fusion import fuse_rankings

SCHEMA = "q string, d string, v double, s string, rank int, places string"


def fused(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    rows = fuse_rankings(df, "q", "d", "v", "s", **options).orderBy("q", "rank").collect()
    return {q: [(r.d, r.median_rank, r.mean_rank) for r in rows if r.q == q] for q in {r.q for r in rows}}


def brute(rows):
    lists = {}
    for q, d, v, s in rows:
        if None not in (q, d, v, s) and v == v:
            one = lists.setdefault(q, {}).setdefault(s, {})
            one[d] = max(v, one.get(d, v))
    out = {}
    for q, systems in lists.items():
        worst = max(map(len, systems.values())) + 1
        items = {d for one in systems.values() for d in one}
        place = lambda one, d: sum(v > one[d] for v in one.values()) + (sum(v == one[d] for v in one.values()) + 1) / 2 if d in one else worst
        all_places = {d: [place(one, d) for one in systems.values()] for d in items}
        out[q] = sorted(((d, statistics.median(p), statistics.mean(p)) for d, p in all_places.items()), key=lambda x: (x[1], round(x[2], 9), x[0]))
    return out


@pytest.mark.parametrize("hot_rows", [100_000, 100, 0])
def test_median_ranks_whatever_the_size_of_the_query(spark, hot_rows):
    rng = random.Random(2)
    rows = [(f"q{rng.choice([0, 0, rng.randrange(5)])}", f"d{rng.randrange(40)}", float(rng.choice([rng.randrange(3), rng.random() * 1000])), f"s{rng.randrange(5)}") for _ in range(900)]
    rows += [("q1", "d1", float("nan"), "s1"), ("q1", None, 1.0, "s1"), (None, "d", 1.0, "s1"), ("q1", "d", None, "s1"), ("q1", "d", 1.0, None)]
    got, want = fused(spark, rows, hot_rows=hot_rows), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _, _ in got[q]] == [d for d, _, _ in want[q]]
        assert [x[1:] for x in got[q]] == [pytest.approx(x[1:]) for x in want[q]]


def test_no_system_dominates_by_its_range(spark):
    rows = [("q", d, v, "small") for d, v in (("a", 0.3), ("b", 0.2), ("c", 0.1))] + [("q", d, v, "large") for d, v in (("c", 9e9), ("a", 8.0), ("b", 7.0))]
    rows += [("q", d, v, "third") for d, v in (("a", -1.0), ("b", -2.0), ("c", -3.0))]
    assert [d for d, _, _ in fused(spark, rows)["q"]] == ["a", "b", "c"]


def test_weights(spark):
    rows = [("q", "a", 2.0, "x"), ("q", "b", 1.0, "x"), ("q", "a", 1.0, "y"), ("q", "b", 2.0, "y")]
    assert [d for d, _, _ in fused(spark, rows, weights={"y": 3.0})["q"]] == ["b", "a"]
    assert [x[1] for x in fused(spark, rows, weights={"y": 3.0})["q"]] == [1.0, 2.0]


def test_few_systems_and_top(spark):
    rows = [("q", "a", 2.0, "x"), ("q", "b", 1.0, "y"), ("p", "a", 1.0, "x")]
    assert set(fused(spark, rows, min_systems=2)) == {"q"}
    assert [len(x) for x in fused(spark, rows, min_systems=2, top=1).values()] == [1]
    assert fused(spark, []) == {}
