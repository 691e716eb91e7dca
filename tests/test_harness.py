import json
import math

import pytest

from tessera import entry
from tessera.plans.harness import evaluate, leaderboard
from tessera.sources import files

DOCS = {"d1": "Red foxes run. The fox is red.", "d2": "Blue whales swim.", "d3": "A fox and a whale.", "d4": "Nothing here."}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    at = tmp_path_factory.mktemp("inputs")
    (at / "corpus.jsonl").write_text("".join(json.dumps({"doc_id": d, "text": t}) + "\n" for d, t in DOCS.items()))
    (at / "topics.tsv").write_text("q1\tred fox\nq2\twhale\nq3\tfox\n")
    (at / "qrels.txt").write_text("q1 0 d1 2\nq1 0 d3 1\nq2 0 d2 1\nq9 0 d1 1\n")
    (at / "base.trec").write_text("q1 Q0 d4 1 2.0 b\nq2 Q0 d2 1 1.0 b\n")
    return at


def test_a_whole_evaluation(spark, inputs, tmp_path):
    path = lambda name: str(inputs / name)
    report = evaluate(spark, path("corpus.jsonl"), path("topics.tsv"), path("qrels.txt"), str(tmp_path / "index"), str(tmp_path / "run"), str(tmp_path / "report"), path("base.trec"), probes=1)
    assert set(report) == {"submission", "num_queries", "num_queries_scored", "skipped_no_qrels", "aggregate_metrics", "leaderboard", "efficiency", "per_query_metrics"}
    assert (report["num_queries"], report["num_queries_scored"], report["skipped_no_qrels"]) == (3, 2, ["q3"])
    assert report["per_query_metrics"]["q1"]["ndcg_10"] == pytest.approx(1.0) and report["aggregate_metrics"]["mrr"] == 0.75  # the shorter d3 comes before d2
    assert report["leaderboard"]["provisional"] == pytest.approx(0.7 * (1 + 1 / math.log2(3)) / 2 + 0.1 * 0.75) and report["leaderboard"]["beats_baseline_ndcg_10"]
    assert report["leaderboard"]["baseline_ndcg_10"] == pytest.approx(0.5)
    assert report["efficiency"]["index_size_bytes"] > 0 and all(v > 0 for v in report["efficiency"].values())
    run = files.read_run(spark, str(tmp_path / "run"))
    assert run.groupBy("qid").count().where("count = 4").count() == 3 and {r.tag for r in run.collect()} == {"tessera"}
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value) == report
    other = json.loads(json.dumps(report)) | {"submission": "slow"}
    other["efficiency"] = {k: v * 3 for k, v in other["efficiency"].items()}
    assert [r["submission"] for r in leaderboard([other, report])] == ["tessera", "slow"] and leaderboard([]) == []


def test_the_entry_point(spark, inputs, tmp_path):
    entry.build_index(str(inputs / "corpus.jsonl"), str(tmp_path / "index"))
    entry.load_index(str(tmp_path / "index"))
    got = entry.retrieve("red fox", 3)
    assert [d for d, _ in got][0] == "d1" and len(got) == 3 and all(isinstance(s, float) for _, s in got)
    assert entry.retrieve("", 2) and entry.conformance(entry) == []


def test_what_is_no_entry_point():
    assert entry.conformance(json) == [f"{f} is missing" for f in entry.SIGNATURES]


def test_lines_are_in_order_of_file_name(spark, tmp_path):
    put = lambda name, ids: (tmp_path / name).write_text("".join(json.dumps({"doc_id": i, "text": "x"}) + "\n\n" for i in ids))
    put("b.jsonl", [f"b{i}" for i in range(500)])
    put("a.jsonl", ["a0", "a1"])
    rows = [(r.ord, r.doc_id) for r in files.read_corpus(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == list(enumerate(["a0", "a1", *(f"b{i}" for i in range(500))]))
