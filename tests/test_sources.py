import json

import pytest

from tessera.operators import evaluation as ev
from tessera.operators.analysis import Analyzer
from tessera.operators.index import build_index
from tessera.sources import files
from tessera.streaming.score_stream import rank_stream


def put(tmp_path, text):
    path = tmp_path / "file"
    path.write_text(text)
    return str(path)


def test_corpus(spark, tmp_path):
    path = put(tmp_path, '{"doc_id": "b", "text": "x", "more": 1}\n\n{"doc_id": "a", "text": ""}\n')
    assert [(r.doc_id, r.text) for r in files.read_corpus(spark, path).orderBy("ord").collect()] == [("b", "x"), ("a", "")]
    with pytest.raises(Exception, match="no text"):
        files.read_corpus(spark, put(tmp_path, '{"doc_id": "b"}\n')).collect()


def test_topics_cut_at_the_first_tab(spark, tmp_path):
    assert files.read_queries(spark, put(tmp_path, 'q1\ta "b\tc\n')).first() == ("q1", 'a "b\tc')
    with pytest.raises(Exception, match="no tab"):
        files.read_queries(spark, put(tmp_path, "q1 a\n")).collect()


def test_judgments_last_line_counts(spark, tmp_path):
    rows = files.read_qrels(spark, put(tmp_path, "q 0 d 1\nq  0 e -1\nq 0 d 3\n")).collect()
    assert {(r.doc_id, r.rel) for r in rows} == {("d", 3), ("e", -1)}
    with pytest.raises(Exception, match="not 4 fields"):
        files.read_qrels(spark, put(tmp_path, "q 0 d\n")).collect()


def test_runs_are_ranked_by_score(spark, tmp_path):
    rows = files.read_run(spark, put(tmp_path, "q Q0 a 1 0.5 t\nq Q0 b 2 0.9 t\nq Q0 c 3 0.5 t\n")).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in rows] == [("b", 1), ("a", 2), ("c", 3)]
    with pytest.raises(Exception, match="not 6 fields"):
        files.read_run(spark, put(tmp_path, "q Q0 a 1 0.5\n")).collect()


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q", "b", 1, 2.0), ("q", "a", 2, 1.25), ("p", "a", 1, 3.0)], "qid string, doc_id string, rank int, score double")
    path = str(tmp_path / "run")
    files.write_run(run, path, "me")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["p Q0 a 1 3.000000 me", "q Q0 a 2 1.250000 me", "q Q0 b 1 2.000000 me"]
    assert {(r.qid, r.doc_id, r.rank) for r in files.read_run(spark, path).collect()} == {("q", "b", 1), ("q", "a", 2), ("p", "a", 1)}


def test_report(spark):
    run = spark.createDataFrame([("q", "a", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 1), ("r", "a", 1)], "qid string, doc_id string, rel int")
    per = ev.per_query_metrics(run, qrels)
    got = json.loads(files.report(ev.aggregate_metrics(per), per).first().value)
    assert got["aggregate_metrics"]["mrr"] == 0.5 and got["per_query_metrics"]["r"]["num_ranked"] == 0


def test_runs_of_several_systems(spark, tmp_path):
    rows = [("x", "q", "a", 1, 0.5), ("x", "q", "b", 2, 0.25), ("y z", "q", "a", 1, -1.0)]
    files.write_runs(spark.createDataFrame(rows, "system string, qid string, doc_id string, rank int, score double"), str(tmp_path / "runs"), "system", "t")
    table = files.read_runs(spark, str(tmp_path / "runs"), "system")
    assert sorted(tuple(r)[:5] for r in table.collect()) == [("x", "q", "a", 0.5, 1), ("x", "q", "b", 0.25, 2), ("y z", "q", "a", -1.0, 1)]


def test_directory_bytes(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a").write_text("12345")
    (tmp_path / "b").write_text("123")
    assert files.directory_bytes(spark, str(tmp_path)) == 8


def test_streamed_topics(spark, tmp_path):
    index = build_index(spark.createDataFrame([(0, "a", "red fox"), (1, "b", "blue fox")], "ord bigint, doc_id string, text string"), Analyzer())
    source = str(tmp_path / "topics")
    spark.createDataFrame([("q1", "red"), ("q2", "fox")], "qid string, text string").write.parquet(source)
    stream = spark.readStream.schema("qid string, text string").parquet(source)
    query = rank_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = {(r.qid, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("q1", "a"), ("q2", "a"), ("q2", "b")}
