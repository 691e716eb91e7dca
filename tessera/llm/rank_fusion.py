"""One ranking per query from differently scaled systems, by median rank.

Ranks replace scores, so range, sign and shape of a system's scores have no
effect.  Within a system tied items share the mean of their places.  Items are
ordered by the weighted median of their ranks, then by the mean rank, then by
identifier.

Queries of ordinary size are handled within one task each, on one shuffle by
query.  Queries of more than ``hot_rows`` rows are ranked in score buckets
instead, so no task ever holds a whole large query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written

#: Rows from which on a query is ranked in score buckets.
HOT_ROWS = 100_000
#: Score buckets of a list of a large query, and copies of a score level in the join back.
BUCKETS, SALT = 256, 16


def _ranked(best: DataFrame) -> DataFrame:
    """Mean-of-ties rank and list size, each (query, system) within one task."""
    lists = Window.partitionBy("query", "system")
    order = lists.orderBy(F.desc("score"))
    # The first and the last place of the tie; the count runs to the last row of an equal score.
    place = (F.rank().over(order) + F.count("*").over(order)) / 2
    return best.select("query", "system", "item", place.cast("double").alias("place"), F.count("*").over(lists).alias("listed"))


def _ranked_in_buckets(best: DataFrame) -> DataFrame:
    """The same for lists of any size: offsets of score buckets plus places within a bucket.

    Tied items are counted as one level before they are ordered, so neither a
    long list nor a long tie gathers in one task.
    """
    lists = ["query", "system"]
    at = [(i + 1) / BUCKETS for i in range(BUCKETS - 1)]
    sizes = best.groupBy(*lists).agg(F.percentile_approx("score", at, BUCKETS * 20).alias("cuts"), F.count("*").alias("listed"))
    levels = best.groupBy(*lists, "score").agg(F.count("*").alias("tied")).join(sizes, lists)
    levels = levels.withColumn("bucket", F.size(F.filter("cuts", lambda c: c > F.col("score")))).drop("cuts")
    totals = levels.groupBy(*lists, "bucket").agg(F.sum("tied").alias("held"))
    earlier = Window.partitionBy(*lists).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*lists, "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    above = Window.partitionBy(*lists, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.join(totals, [*lists, "bucket"])
    place = F.col("offset") + F.coalesce(F.sum("tied").over(above), F.lit(0)) + (F.col("tied") + 1) / 2
    levels = levels.select(*lists, "score", "listed", place.cast("double").alias("place"))
    levels = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = best.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALT)).cast("int"))
    return salted.join(levels, [*lists, "score", "salt"]).select(*lists, "item", "place", "listed")


def _weight(weights: dict[str, float] | None) -> Column:
    weight = F.lit(1.0)
    for tag, w in (weights or {}).items():
        weight = F.when(F.col("system") == tag, F.lit(float(w))).otherwise(weight)
    return weight


def _median(places: Column, half: Column) -> Column:
    """Mean of lower and upper weighted median of an array of (place, weight) in order of place."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(s: Column, p: Column) -> Column:
        total = s["sum"] + p["weight"]
        low = F.when(s["low"].isNull() & (total >= half - 1e-9), p["place"]).otherwise(s["low"])
        high = F.when(s["high"].isNull() & (total > half + 1e-9), p["place"]).otherwise(s["high"])
        return F.struct(total.alias("sum"), low.alias("low"), high.alias("high"))

    return F.aggregate(places, state, step, lambda s: (s["low"] + F.coalesce(s["high"], s["low"])) / 2)


ORDER = ["median_rank", "mean_rank", "item"]


def _numbered(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*ORDER)))


def _numbered_in_ranges(ranked: DataFrame) -> DataFrame:
    """The same for queries of any size: places within ranges of the order, plus the items of the earlier ranges."""
    placed = ranked.repartitionByRange("query", *ORDER).sortWithinPartitions("query", *ORDER).withColumn("range", F.spark_partition_id())
    placed = written(placed, "ranges")
    sizes = placed.groupBy("query", "range").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("query").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("query", "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    within = placed.withColumn("place", F.row_number().over(Window.partitionBy("query", "range").orderBy(*ORDER)))
    return within.join(offsets, ["query", "range"]).withColumn("rank", (F.col("offset") + F.col("place")).cast("int")).drop("range", "offset", "place")


def fuse_rankings(
    df: DataFrame, query_col: str, item_col: str, score: str, system: str, top: int | None = None, min_systems: int = 1, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(query, item, median_rank, mean_rank, n_systems, rank)``: one order of items per query.

    Rows with a null query, system, item or score, or a NaN score, are left
    out; an item counts once per list, with its highest score.  An item that a
    system of its query does not list takes in that list a place behind every
    listed item of the query (one more than the longest list).  Queries of fewer
    than ``min_systems`` systems are left out.  ``weights`` gives systems a
    positive weight other than 1.  ``top`` keeps the first so many per query.
    An empty table gives an empty one.
    """
    rows = df.select(F.col(query_col).alias("query"), F.col(system).alias("system"), F.col(item_col).alias("item"), (F.col(score).cast("double") + 0.0).alias("score"))
    rows = rows.dropna().where(~F.isnan("score"))
    sizes = rows.groupBy("query").agg(F.count("*").alias("rows"))
    hot = sizes.where(F.col("rows") > hot_rows).select("query")
    some_hot = bool(hot.head(1))

    def one_each(part: DataFrame) -> DataFrame:
        return part.groupBy("query", "system", "item").agg(F.max("score").alias("score"))

    def by_item(places: DataFrame, *more: Column) -> DataFrame:
        return places.groupBy("query", "item").agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("places"), *more)

    # Each list's rows add up to 1 / listed each, so sums over a query count its lists and their weights.
    totals = {"lists": F.sum(1 / F.col("listed")), "all": F.sum(F.col("weight") / F.col("listed")), "longest": F.max("listed")}
    cold = rows.join(hot, "query", "left_anti") if some_hot else rows
    query = Window.partitionBy("query")
    places = _ranked(one_each(cold.repartition("query"))).withColumn("weight", _weight(weights))
    places = places.withColumns({c: x.over(query) for c, x in totals.items()})
    joined = by_item(places, *(F.first(c).alias(c) for c in totals))
    if some_hot:
        best = written(one_each(rows.join(hot, "query", "left_semi")), "large-queries")
        places = _ranked_in_buckets(best).withColumn("weight", _weight(weights))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        lists = places.groupBy("query").agg(*(x.alias(c) for c, x in totals.items())).withColumn("salt", salts)
        items = by_item(places).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALT)).cast("int"))
        joined = joined.unionByName(items.join(lists, ["query", "salt"]).drop("salt"))
    joined = joined.where(F.round("lists") >= min_systems).withColumn("all", F.round("all", 9))

    behind = (F.col("longest") + 1).cast("double")
    missing = F.col("all") - F.aggregate("places", F.lit(0.0), lambda s, p: s + p["weight"])
    filled = F.when(missing > 1e-9, F.concat("places", F.array(F.struct(behind.alias("place"), missing.alias("weight"))))).otherwise(F.col("places"))
    joined = joined.withColumn("filled", filled)
    mean = F.aggregate("filled", F.lit(0.0), lambda s, p: s + p["place"] * p["weight"]) / F.col("all")
    ranked = joined.select("query", "item", _median(F.col("filled"), F.col("all") / 2).alias("median_rank"), mean.alias("mean_rank"), F.size("places").alias("n_systems"))
    if some_hot and top is None:
        ranked = written(ranked, "fused")
        ranked = _numbered(ranked.join(hot, "query", "left_anti")).unionByName(_numbered_in_ranges(ranked.join(hot, "query", "left_semi")))
    else:
        ranked = _numbered(ranked)  # with a limit, each task passes on so many items per query at most
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(F.col("query").alias(query_col), F.col("item").alias(item_col), "median_rank", "mean_rank", "n_systems", "rank")
