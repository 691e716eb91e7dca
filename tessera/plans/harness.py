"""One call from a collection, topics and judgments to a checked run and a full report."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer
from tessera.operators.index import Index, build_index
from tessera.scratch import scope, written
from tessera.session import prepare
from tessera.sources import files


def _timed(work):
    began = time.perf_counter()
    result = work()
    return result, time.perf_counter() - began


def _metrics(per: DataFrame) -> dict:
    row = ev.aggregate_metrics(per).first().asDict()
    return {c: row[c] for c in ev.METRICS}


def evaluate(
    spark: SparkSession, corpus: str, queries: str, qrels: str, index_dir: str, run_out: str | None = None, report_out: str | None = None,
    baseline_run: str | None = None, k: int = 10, run_tag: str = "tessera", analyzer: Analyzer = Analyzer(title_boost=rk.ENTRY_TITLE_BOOST), probes: int = 0, **retrieval,
) -> dict:
    """Build, save, load in a new session, rank all topics, check, write and measure; the report as a dict.

    ``submission``, ``num_queries``, ``num_queries_scored``,
    ``skipped_no_qrels``, ``aggregate_metrics``, ``leaderboard``, ``efficiency``
    and ``per_query_metrics``.  All topics are ranked in one batch: the mean
    latency is the batch's time by topic, the longest that of the batch, as a
    topic waits for all of it.  With ``probes`` so many topics are asked alone
    as well, and the longest is the slowest of them.  The report grows with the
    topics, which people judge by hand.  ``retrieval`` goes to ``ranking.retrieve``.
    """
    with scope():

        def build() -> None:
            index = build_index(files.read_corpus(spark, corpus), analyzer)
            index.save(index_dir)
            index.close()

        _, build_seconds = _timed(build)
        fresh = prepare(spark.newSession())
        index, load_seconds = _timed(lambda: Index.load(fresh, index_dir))
        asked = files.read_queries(fresh, queries)
        ranked, batch_seconds = _timed(lambda: written(rk.retrieve(asked, index, k, **retrieval), "ranked"))
        run = rk.checked_run(ranked, k)
        n = asked.select("qid").distinct().count()
        slowest = batch_seconds
        if probes:
            alone = [fresh.createDataFrame([tuple(r)], "qid string, text string") for r in asked.orderBy("qid").limit(probes).collect()]
            slowest = max(_timed(lambda q=q: rk.retrieve(q, index, k, **retrieval).collect())[1] for q in alone)
        judged = written(files.read_qrels(fresh, qrels), "judgments")
        per = written(ev.per_query_metrics(run, judged, k).join(asked.select("qid").distinct(), "qid", "left_semi"), "per-query")
        own = _metrics(per)
        leaderboard = {"provisional": ev.NDCG_WEIGHT * own["ndcg_10"] + ev.MAP_WEIGHT * own["map_10"]}
        if baseline_run:
            base = _metrics(ev.per_query_metrics(files.read_run(fresh, baseline_run), judged, k).join(asked.select("qid").distinct(), "qid", "left_semi"))
            for m in ("ndcg_10", "map_10"):
                leaderboard |= {f"baseline_{m}": base[m], f"beats_baseline_{m}": own[m] > base[m]}
        rows = per.orderBy("qid").collect()
        report = {
            "submission": run_tag,
            "num_queries": n,
            "num_queries_scored": len(rows),
            "skipped_no_qrels": sorted(r.qid for r in ev.skipped_queries(asked, judged).collect()),
            "aggregate_metrics": own,
            "leaderboard": leaderboard,
            "efficiency": {
                "index_build_seconds": build_seconds,
                "index_load_seconds": load_seconds,
                "index_size_bytes": files.directory_bytes(spark, index_dir),
                "mean_query_latency_seconds": batch_seconds / n if n else 0.0,
                "max_query_latency_seconds": slowest,
            },
            "per_query_metrics": {r.qid: {c: v for c, v in r.asDict().items() if c != "qid"} for r in rows},
        }
        if run_out:
            files.write_run(run, run_out, run_tag)
        if report_out:
            fresh.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(report_out)
        index.close()
        return report


def leaderboard(reports: list[dict]) -> list[dict]:
    """Several reports by total score: provisional score, speed and index size relative to the medians of all."""
    if not reports:
        return []
    spark = SparkSession.getActiveSession()
    cost = lambda r, c: float(r["efficiency"][c])
    rows = [(r["submission"], r["leaderboard"]["provisional"], cost(r, "index_build_seconds"), cost(r, "mean_query_latency_seconds"), cost(r, "index_size_bytes")) for r in reports]
    table = spark.createDataFrame(rows, "submission string, provisional double, build double, latency double, size double")
    mid = table.agg(*(F.median(c).alias(c) for c in ("build", "latency", "size"))).first()
    speed = ev.efficiency_modifier(F.col("build"), F.col("latency"), F.lit(mid["build"]), F.lit(mid["latency"]))
    size = ev.index_size_score(F.col("size"), F.lit(mid["size"]))
    scored = table.select("submission", "provisional", speed.alias("efficiency"), size.alias("index_size")).withColumn("total", F.expr("provisional + efficiency + index_size"))
    return [r.asDict() for r in scored.orderBy(F.desc("total"), "submission").collect()]
