"""Ranking metrics, leaderboard scores and their aggregates.

A run is ``(qid, doc_id, rank)``, judgments are ``(qid, doc_id, rel)`` with one
row per pair.  Runs may carry more key columns, e.g. one per setting of a sweep;
``by`` names them and every setting is measured in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import written

#: Depth of nDCG and MAP, and the weights of the leaderboard.
DEPTH = 10
NDCG_WEIGHT, MAP_WEIGHT, EFFICIENCY_WEIGHT, SIZE_WEIGHT = 0.70, 0.10, 0.10, 0.10
#: Settings that are sent to every task.
BROADCAST_SETTINGS = 100_000
METRICS = ["ndcg_10", "map_10", "mrr", "p_k"]


def dedup_keep_first(run: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each document once per query, at its first place, ranks closed up."""
    first = run.groupBy(*by, "qid", "doc_id").agg(F.min("rank").alias("at"))
    order = Window.partitionBy(*by, "qid").orderBy("at", "doc_id")
    return first.select(*by, "qid", "doc_id", F.row_number().over(order).alias("rank"))


def _gain(rel: Column, rank: Column) -> Column:
    """(2^rel - 1) / log2(rank + 1); a negative grade costs."""
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def ideal_dcg(qrels: DataFrame, k: int = DEPTH) -> DataFrame:
    """``(qid, idcg, n_relevant)`` from all judgments of a query."""
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), F.asc("doc_id"))
    ideal = qrels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(F.sum(_gain(F.col("rel"), F.col("place"))).alias("idcg"))
    relevant = qrels.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("n_relevant"))
    return relevant.join(ideal, "qid")


def per_query_metrics(run: DataFrame, qrels: DataFrame, k: int = DEPTH, by: tuple[str, ...] = (), settings: list[tuple] | None = None) -> DataFrame:
    """``ndcg_10, map_10, mrr, p_k, num_ranked`` per setting and judged query.

    A judged query that the run lacks scores 0 throughout; run queries without
    judgments are left out.  nDCG and MAP have a depth of 10, only precision
    uses ``k``; with ``k`` 0 it is 0.  A query whose ideal is 0 has nDCG 0, one
    without relevant documents MAP 0.  ``settings`` lists the values of ``by``;
    where it is absent they are those of the run, which is then computed once more.
    """
    ranked = dedup_keep_first(run, by)
    known = qrels.select("qid", "doc_id", "rel")
    judged = ranked.join(known, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hit = F.when(F.col("rel") > 0, 1).otherwise(0)
    hits = F.sum(hit).over(Window.partitionBy(*by, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumns({"hit": hit, "hits": hits})
    within = F.col("rank") <= DEPTH
    sums = judged.groupBy(*by, "qid").agg(
        F.sum(F.when(within, _gain(F.col("rel"), F.col("rank")))).alias("dcg"),
        F.sum(F.when(within & (F.col("hit") == 1), F.col("hits") / F.col("rank"))).alias("precisions"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias("found"),
        F.count("*").alias("num_ranked"),
    )
    asked = ideal_dcg(qrels)
    if by:
        if settings is None:
            points = written(run.select(*by).distinct(), "settings")
        else:
            points = run.sparkSession.createDataFrame(settings, T.StructType([run.schema[c] for c in by]))
        # Every setting has a row for every judged query, so that those a run lacks score 0.
        few = settings is not None or points.count() <= BROADCAST_SETTINGS
        asked = asked.join(F.broadcast(points) if few else points)
    joined = asked.join(sums, [*by, "qid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *by,
        "qid",
        zero(F.when(F.col("idcg") != 0, F.col("dcg") / F.col("idcg"))).alias("ndcg_10"),
        zero(F.when(F.col("n_relevant") > 0, F.col("precisions") / F.col("n_relevant"))).alias("map_10"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("found") / k if k else F.lit(0.0)).alias("p_k"),
        F.coalesce("num_ranked", F.lit(0)).alias("num_ranked"),
    )


def aggregate_metrics(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the judged queries, 0 without any, and their number."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS]
    return per_query.groupBy(*by).agg(*means, F.count("*").alias("num_queries"))


def evaluate_run(run: DataFrame, qrels: DataFrame, k: int = DEPTH, by: tuple[str, ...] = (), settings: list[tuple] | None = None) -> DataFrame:
    return aggregate_metrics(per_query_metrics(run, qrels, k, by, settings), by)


def skipped_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid)`` of run queries that have no judgment."""
    return run.select("qid").distinct().join(qrels.select("qid").distinct(), "qid", "left_anti")


def provisional_score(ndcg: Column, map_: Column) -> Column:
    return NDCG_WEIGHT * ndcg + MAP_WEIGHT * map_


def _relative_speed(own: Column, median: Column) -> Column:
    """1 at no time at all, falling by 1 per median, down to -3; 0 without a median."""
    part = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - own / F.when(median > 0, median) / 2))
    return F.when(median > 0, part * 2 - 1).otherwise(0.0)


def efficiency_modifier(build: Column, latency: Column, median_build: Column, median_latency: Column) -> Column:
    """Mean of both relative speeds, times its weight."""
    return (_relative_speed(build, median_build) + _relative_speed(latency, median_latency)) / 2 * EFFICIENCY_WEIGHT


def index_size_score(own: Column, median: Column) -> Column:
    """Full weight up to half the median size, none from its double on, linear between; 0 without a median."""
    ratio = own / F.when(median > 0, median)
    between = (1 - (ratio - 0.5) / 1.5) * SIZE_WEIGHT
    return F.when(ratio <= 0.5, SIZE_WEIGHT).when(ratio >= 2.0, 0.0).when(ratio.isNotNull(), between).otherwise(0.0)


def summarize(own: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: metrics and provisional score of a run's aggregate, and whether it strictly beats a baseline's."""
    b = baseline.select(F.col("ndcg_10").alias("baseline_ndcg_10"), F.col("map_10").alias("baseline_map_10")).first()
    row = own.select("ndcg_10", "map_10", provisional_score(F.col("ndcg_10"), F.col("map_10")).alias("provisional"), F.lit(b[0]).alias("baseline_ndcg_10"), F.lit(b[1]).alias("baseline_map_10"))
    return row.select("*", (F.col("ndcg_10") > F.col("baseline_ndcg_10")).alias("beats_ndcg_10"), (F.col("map_10") > F.col("baseline_map_10")).alias("beats_map_10"))
