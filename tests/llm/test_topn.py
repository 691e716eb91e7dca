import math
import random

import pytest

from tessera.llm.topn import ROW_GROUP_BYTES, cluster_by_group, scan_file, top_per_group

SCHEMA = "q string, s string, d string, v double, rank int, item string, score string, g0 int"


def brute(rows, n):
    best = {}
    for q, s, d, v in rows:
        if None not in (q, s, d, v) and not math.isnan(v):
            group = best.setdefault((q, s), {})
            group[d] = max(v, group.get(d, -math.inf))
    return {(q, s, d, i) for (q, s), docs in best.items() for i, (d, _) in enumerate(sorted(docs.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def found(spark, rows, n=3, **options):
    df = spark.createDataFrame([(*r, 1, "x", "y", 0) for r in rows], SCHEMA)
    got = top_per_group(df, ["q", "s"], "d", "v", n, **options)
    assert got.columns == ["q", "s", "d", "v", "rank"]
    return {(r.q, r.s, r.d, r["rank"]) for r in got.collect()}


def test_nulls_nans_ties_and_repeats(spark):
    rows = [("q", "a", "d1", 1.0), ("q", "a", "d1", 5.0), ("q", "a", "d0", 5.0), ("q", "a", "é", 5.0), ("q", "a", "z", 5.0), ("q", "a", "n", float("nan")),
            (None, "a", "d", 9.0), ("q", None, "d", 9.0), ("q", "a", None, 9.0), ("q", "a", "x", None), ("q", "b", "d", -0.0), ("q", "b", "c", 0.0), ("q", "b", "i", float("-inf"))]
    assert found(spark, rows) == brute(rows, 3)
    assert ("q", "b", "c", 1) in found(spark, rows)  # 0.0 and -0.0 are a tie


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("q", "a", None, 1.0)]) == set()


def test_one_hot_group_over_many_files(spark):
    rng = random.Random(1)
    rows = [(f"q{rng.choice([0, 0, 0, rng.randrange(30)])}", rng.choice("ab"), f"d{rng.randrange(400)}", float(rng.randrange(50))) for _ in range(4000)]
    assert found(spark, rows, 10, row_group_bytes=2048) == brute(rows, 10)


def test_row_groups_below_the_bar_are_skipped(spark, tmp_path):
    df = spark.range(60_000).selectExpr("'q' as g0", "cast(id % 50000 as string) as item", "cast(id as double) as score")
    path = str(tmp_path / "t")
    cluster_by_group(df.coalesce(1), ["g0"], "item", "score", path, row_group_bytes=65536)
    files = [f"file://{p}" for p in sorted((tmp_path / "t").glob("*.parquet"))]
    scans = [scan_file(f, ["g0"], 5) for f in files]
    assert sum(skipped for _, _, skipped in scans) > 3 * sum(read for _, read, _ in scans)
    best = sorted((s for held, _, _ in scans for s in held["score"].to_pylist()), reverse=True)[:5]
    assert best == [59999.0, 59998.0, 59997.0, 59996.0, 59995.0]


def test_row_groups_of_the_hot_query_are_skipped(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/dev_run.parquet").selectExpr("qid as g0", "run_tag as g1", "doc_id as item", "score").dropna().where("not isnan(score)")
    path = str(tmp_path / "t")
    cluster_by_group(rows, ["g0", "g1"], "item", "score", path, ROW_GROUP_BYTES)
    scans = [scan_file(f"file://{p}", ["g0", "g1"], 10) for p in sorted((tmp_path / "t").glob("*.parquet"))]
    assert sum(read for _, read, _ in scans) > 0 and sum(skipped for _, _, skipped in scans) > 0


def test_a_row_group_at_the_bar_is_read(spark):
    rows = [("q", "s", f"d{i:05}", 1.0) for i in range(9000, 0, -1)]
    assert found(spark, rows, 2, row_group_bytes=1024) == {("q", "s", "d00001", 1), ("q", "s", "d00002", 2)}


@pytest.mark.parametrize("n", [1, 7])
def test_integer_items(spark, n):
    df = spark.createDataFrame([(i % 3, i, float(i % 10)) for i in range(100)], "k int, i bigint, v double")
    got = {(r.k, r.i) for r in top_per_group(df, ["k"], "i", "v", n).collect()}
    want = {(k, i) for k in range(3) for i in sorted((i for i in range(100) if i % 3 == k), key=lambda i: (-(i % 10), i))[:n]}
    assert got == want
