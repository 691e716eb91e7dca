"""Boolean, cosine, BM25 and RM3 retrieval of whole query sets.

A query set is ``(qid, text)``.  Scored results are ``(qid, ord, score)``;
rankings are ``(qid, ord, doc_id, score, rank)``.  Scores are compared after
rounding to six digits, ties going to the smaller ``ord``, so that the order in
which partial sums are added never shows.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import Part, best_documents, matches
from tessera.operators.index import Index, term_bucket, vsm_idf
from tessera.scratch import written, written_once

#: Query terms (rows of query and term) that are sent to every task at a time, and rows up to which terms become a filter.
BROADCAST_QUERY_TERMS, FEW_QUERY_TERMS = 500_000, 64
#: Scored postings that a task should have at a time; more would spill while they are grouped by query and document.
SCORED_PER_TASK = 4_000_000
#: Tokens of the documents that a ranking task holds, unless a division has more, and rows that rankings of a job send to be merged.
TASK_TOKENS, MERGED_ROWS = 4_000_000, 40_000_000

#: Textbook parameters, and those of the default configuration.
K1, B = 1.2, 0.75
ENTRY_K1, ENTRY_B, ENTRY_TITLE_BOOST = 1.5, 0.75, 2
FB_DOCS, FB_TERMS, ALPHA, MIN_IDF = 40, 30, 0.4, 0.5


def top_k(scored: DataFrame, index: Index, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The ``k`` best documents of positive score per query, with their ids.

    The rank limit runs before the shuffle as well, so a query that matches
    everything sends ``k`` rows per task.
    """
    # Millionths as a whole number: what rounding to six digits orders by, without a decimal per row.
    order = Window.partitionBy(*by).orderBy(F.desc((F.col("score") * 1e6 + 0.5).cast("bigint")), F.asc("ord"))
    best = scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(index.docs.select("ord", "doc_id"), "ord").select(*by, "ord", "doc_id", "score", "rank")


def known_terms(asked: DataFrame, index: Index) -> DataFrame:
    """Query terms ``(..., term, ...)`` that the collection holds, with ``df`` and ``key``."""
    return asked if "df" in asked.columns else asked.join(index.terms.select("term", "df", "key"), "term")


def matching_postings(asked: DataFrame, index: Index, *parts: Column) -> DataFrame:
    """Postings joined with the query terms ``(qid, ..., term, ...)`` of a batch: ``ord``, ``parts``, columns of ``asked``.

    ``parts`` are columns over ``tf``, ``dl`` and ``df``, computed once per
    posting and not once per posting and query.

    Only the buckets that hold an asked term are read; a batch of few rows
    filters by its terms as well.  Postings are stored divided by document, so
    they stay where they are read, the queries are sent to them, and what is
    grouped by query and document needs no shuffle: the rows that multiply with
    the number of queries never move, only each division's best do.

    One job prepares a batch: it writes the query terms and counts them, the
    postings that they will meet and the buckets that they are in.  A batch of
    more rows than are to be sent, or of more work than the divisions' tasks
    should have, goes through in slices of queries.
    """
    sizes = Observation()
    places = F.call_function("shiftleft", F.lit(1).cast("bigint"), term_bucket(F.col("term"), index.buckets))
    known = known_terms(asked, index).observe(sizes, F.count(F.lit(1)).alias("rows"), F.sum("df").alias("work"), F.bit_or(places).alias("buckets"))
    known = written(known, "query-terms").drop("df", "key")
    rows, work, held = (sizes.get[c] or 0 for c in ("rows", "work", "buckets"))
    postings = index.postings.where(F.col("bucket").isin([b for b in range(index.buckets) if held >> b & 1])).drop("bucket")
    if rows <= FEW_QUERY_TERMS:
        postings = postings.where(F.col("term").isin([r.term for r in known.select("term").distinct().collect()]))
    postings = postings.select("term", "ord", *parts)
    slices = max(1, math.ceil(rows / BROADCAST_QUERY_TERMS), math.ceil(work / index.divisions / SCORED_PER_TASK))
    place = F.pmod(F.xxhash64("qid"), F.lit(slices))
    return reduce(DataFrame.unionByName, (postings.join(F.broadcast(known.where(place == i) if slices > 1 else known), "term").drop("term") for i in range(slices)))


# The best of a batch


def distinct_queries(queries: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """The weights of one query of each set of alike ones, and ``(qid, asker)`` with all that it stands for."""
    each = query_weights(queries, index).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "weight", "df", "key"))).alias("held"))
    alike = written(each.groupBy("held").agg(F.min("qid").alias("qid"), F.collect_list("qid").alias("askers")), "queries")
    return alike.select("qid", F.explode("held").alias("t")).select("qid", "t.*"), alike.select("qid", F.explode("askers").alias("asker"))


def answered(rows: DataFrame, askers: DataFrame) -> DataFrame:
    """``rows`` of one query of each set of alike ones, for all queries of the set."""
    others = [c for c in rows.columns if c != "qid"]
    return rows.join(askers, "qid").select(F.col("asker").alias("qid"), *others)


def named(best: DataFrame, index: Index) -> DataFrame:
    """``best`` with the documents' ids."""
    return best.join(index.docs.select("ord", "doc_id"), "ord").select(*(c for c in best.columns if c not in ("score", "rank")), "doc_id", "score", "rank")


def best_of(asked: DataFrame, index: Index, k: int, parts: list[Part], keys: tuple[str, ...] = ("qid",), postings: DataFrame | None = None, values: tuple[str, ...] = ("tf", "dl"), mixes: list[float] | None = None, match: str = "") -> DataFrame:
    """``(keys, p, ord, score, rank)``: the ``k`` best documents of every query ``(keys, term, key, w)`` under part ``p`` of ``parts``.

    Postings stay where they are read, as a task holds its documents whole; it
    takes the queries from the scratch folder, a few thousand at a time, and
    sums in arrays, so neither scored postings nor queries are grouped or moved.
    With ``mixes``, ``asked`` has two weights, ``own`` and ``more``, and ``some``
    in place of ``w``; the only part gives a ranking for every share ``p`` of
    ``own`` in the sum of both, or by ``own`` alone where ``some`` is false.

    With ``match``, ``all`` or ``some``, the result is ``(keys, ord)`` of all
    documents that hold the terms, and no row of it moves.

    What moves are the best of each task.  A batch of more than ``MERGED_ROWS``
    of those goes through in slices of queries, each merged before the next.
    """
    spark, sizes = index.spark, Observation()
    places = F.call_function("shiftleft", F.lit(1).cast("bigint"), term_bucket(F.col("term"), index.buckets))
    seen = asked.observe(sizes, F.count(F.lit(1)).alias("rows"), F.bit_or(places).alias("buckets"), F.approx_count_distinct("key").alias("terms"))
    names = ["w"] if mixes is None else ["own", "more"]
    vectors = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("key", *names))).alias("t"), (F.lit(True) if mixes is None else F.max("some")).alias("some"))
    vectors = written(vectors.select(*keys, F.monotonically_increasing_id().alias("q"), "some", F.col("t.key").alias("terms"), *(F.col(f"t.{c}").alias(f"weights_{i}") for i, c in enumerate(names))), "query-vectors")
    queries = vectors.count()
    if not queries:
        return vectors.selectExpr(*keys, "0 as p", "q as ord", "0D as score", "0 as rank")
    rows, held, terms = (sizes.get[c] for c in ("rows", "buckets", "terms"))
    scan = (index.postings if postings is None else postings).where(F.col("bucket").isin([b for b in range(index.buckets) if held >> b & 1]))
    if index.postings.rdd.getNumPartitions() != index.divisions:
        scan = scan.repartition(index.divisions, "ord")
    named_terms = index.terms.select("term", "key")
    if rows <= FEW_QUERY_TERMS:
        few = [r.term for r in named_terms.join(F.broadcast(vectors.select(F.explode("terms").alias("key")).distinct()), "key", "left_semi").collect()]
        scan, named_terms = scan.where(F.col("term").isin(few)), named_terms.where(F.col("term").isin(few))
    tasks = min(index.divisions, max(spark.sparkContext.defaultParallelism, math.ceil(index.total_length / TASK_TOKENS)))
    slices = max(1, math.ceil(queries * len(mixes or parts) * max(k, 0) * tasks / MERGED_ROWS), math.ceil(terms / BROADCAST_QUERY_TERMS))
    order = Window.partitionBy("q", "p").orderBy(F.desc(F.floor(F.col("score") * 1e6 + 0.5)), F.asc("ord"))

    def ranked(i: int) -> DataFrame:
        own = vectors.where(F.pmod("q", F.lit(slices)) == i).select(F.explode("terms").alias("key")).distinct()
        hits = scan.join(F.broadcast(named_terms.join(own, "key", "left_semi")), "term").select("key", "ord", *values)
        if match:
            run = partial(matches, path=vectors.scratch_path, every=match == "all", slices=slices, slice_=i)
            return hits.coalesce(tasks).mapInArrow(run, "q bigint, ord bigint")
        run = partial(best_documents, path=vectors.scratch_path, parts=parts, k=k, slices=slices, slice_=i, mixes=mixes)
        found = hits.coalesce(tasks).mapInArrow(run, "q bigint, p int, ord bigint, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if match:
        return reduce(DataFrame.unionByName, map(ranked, range(slices))).join(vectors.select("q", *keys), "q").select(*keys, "ord")
    each = [ranked(i) if slices == 1 else written_once(ranked(i), "ranked") for i in range(slices)]
    return reduce(DataFrame.unionByName, each).join(vectors.select("q", *keys), "q").select(*keys, "p", "ord", "score", "rank")


def best_mixed(asked: DataFrame, index: Index, k: int, part: Part, mixes: list[float], keys: tuple[str, ...]) -> DataFrame:
    """``best_of`` for two weights of every term, mixed in shares of which ``p`` is the number."""
    return best_of(asked, index, k, [part], tuple(keys), mixes=mixes)


# Boolean


def boolean_search(queries: DataFrame, index: Index, mode: str = "and") -> DataFrame:
    """``(qid, ord)`` of the documents that hold all (``and``) or some (``or``) of a query's terms.

    With ``and`` a term that no document holds makes the result empty.  A query
    without terms matches nothing.  Any other mode is refused; case is ignored.
    """
    if mode.lower() not in ("and", "or"):
        raise ValueError(f"mode {mode!r} is neither 'and' nor 'or'")
    return answered(*_matched(queries, index, mode))


def _matched(queries: DataFrame, index: Index, mode: str) -> tuple[DataFrame, DataFrame]:
    """``(qid, ord)`` of one query of each set of alike ones, and what each stands for."""
    if mode.lower() == "and":
        unknown = index.analyzed(queries).join(index.terms.select("term"), "term", "left_anti").select("qid").distinct()
        queries = queries.join(unknown, "qid", "left_anti")
    weights, askers = distinct_queries(queries, index)
    match = "all" if mode.lower() == "and" else "some"
    return best_of(weights.withColumnRenamed("weight", "w"), index, 0, [], values=(), match=match), askers


def boolean_ids(queries: DataFrame, index: Index, mode: str = "and") -> DataFrame:
    """``(qid, doc_id)`` of the same; ids are joined before alike queries are told apart."""
    found, askers = _matched(queries, index, mode)
    return answered(found.join(index.docs.select("ord", "doc_id"), "ord").select("qid", "doc_id"), askers)


# Vector space


def vsm_norms(index: Index) -> DataFrame:
    """``(ord, norm)``: length of every document's (1 + log10 tf) idf vector, made with the index; 1 where that is 0."""
    return index.docs.select("ord", "norm")


def vsm_scores(queries: DataFrame, index: Index) -> DataFrame:
    """Cosine of query and document, both weighted by (1 + log tf) idf.

    The query's length counts terms of the collection only; where it is 0 the
    query has no row.
    """
    asked = known_terms(index.analyzed(queries), index).withColumn("idf", vsm_idf(index.n_docs))
    asked = asked.withColumn("qw", (1 + F.log10("qtf")) * F.col("idf"))
    asked = asked.withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("qid")))).where("qn > 0")
    asked = asked.select("qid", "term", "df", (F.col("qw") * F.col("idf")).alias("w"), "qn")
    hits = matching_postings(asked, index, (1 + F.log10("tf")).alias("part"))
    dots = hits.groupBy("qid", "ord").agg(F.sum(F.col("w") * F.col("part")).alias("dot"), F.first("qn").alias("qn"))
    return dots.join(vsm_norms(index), "ord").select("qid", "ord", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))


def _cosine_part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1 + np.log10(tf)) / norm


def vsm(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every query by ``vsm_scores``."""
    weights, askers = distinct_queries(queries, index)
    asked = weights.withColumn("idf", vsm_idf(index.n_docs)).withColumn("qw", (1 + F.log10("weight")) * F.col("idf"))
    asked = asked.withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("qid")))).where("qn > 0 and idf > 0")
    asked = asked.select("qid", "term", "key", (F.col("qw") * F.col("idf") / F.col("qn")).alias("w"))
    # A norm per document goes to the divisions; postings stay.
    norms = vsm_norms(index).repartition(index.divisions, "ord").hint("shuffle_hash")
    best = best_of(asked, index, k, [_cosine_part], postings=index.postings.join(norms, "ord"), values=("tf", "norm"))
    return answered(named(best.drop("p"), index), askers)


# BM25


def bm25_idf(index: Index) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), never negative."""
    return F.log(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_saturation(index: Index, k1: Column | float, b: Column | float) -> Column:
    """The part of a posting's weight that depends on tf and length."""
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.length_unit)))


def _saturated(tf: np.ndarray, dl: np.ndarray, k1: float, b: float, unit: float) -> np.ndarray:
    tf = tf.astype(np.float64)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / unit))


def bm25_part(index: Index, k1: float, b: float) -> Part:
    """The same of a task's arrays."""
    return partial(_saturated, k1=float(k1), b=float(b), unit=float(index.length_unit))


def bm25_impacts(index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """``(term, ord, impact)``: each posting's weight for a query weight of 1."""
    return index.postings.select("term", "ord", (bm25_idf(index) * bm25_saturation(index, k1, b)).alias("impact"))


def query_weights(queries: DataFrame, index: Index) -> DataFrame:
    """``(qid, term, weight, df, key)``: counts in the query, of terms that the collection holds."""
    return known_terms(index.analyzed(queries), index).select("qid", "term", F.col("qtf").cast("double").alias("weight"), "df", "key")


def weighted(weights: DataFrame, index: Index, *keys: str) -> DataFrame:
    """``(keys, term, df, key, w)``: known terms, their weights times idf."""
    return known_terms(weights, index).select(*keys, "term", "df", "key", (F.col("weight") * bm25_idf(index)).alias("w"))


def bm25_scores(weights: DataFrame, index: Index, k1: float = K1, b: float = B, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Scores of weighted queries ``(qid, term, weight)``; weights up to 0 are skipped."""
    asked = weighted(weights.where("weight > 0"), index, *by)
    hits = matching_postings(asked, index, bm25_saturation(index, k1, b).alias("part"))
    return hits.groupBy(*by, "ord").agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def bm25_best(weights: DataFrame, index: Index, k: int, k1: float = K1, b: float = B, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``(by, ord, score, rank)``: the ``k`` best documents of weighted queries ``(by, term, weight)``."""
    return best_of(weighted(weights.where("weight > 0"), index, *by), index, k, [bm25_part(index, k1, b)], by).drop("p")


def bm25(queries: DataFrame, index: Index, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    weights, askers = distinct_queries(queries, index)
    return answered(named(bm25_best(weights, index, k, k1, b), index), askers)


# RM3


def feedback_of(ranked: DataFrame, fb_docs: Column | int = FB_DOCS, keys: tuple[str, ...] = ("qid",), more: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, more, ord, p)``: the first ``fb_docs`` of each ranking, weighted by their share of the scores."""
    best = ranked.where(F.col("rank") <= fb_docs)
    return best.select(*keys, *more, "ord", (F.col("score") / F.sum("score").over(Window.partitionBy(*keys))).alias("p"))


def feedback_weights(first_pass: DataFrame, index: Index, fb_docs: int = FB_DOCS) -> DataFrame:
    """``(qid, ord, p)``: the best documents of a first pass, weighted by their share of the scores."""
    return feedback_of(top_k(first_pass, index, fb_docs), fb_docs)


def relevance_model(feedback: DataFrame, index: Index, keys: tuple[str, ...] = ("qid",), whole: bool = False) -> DataFrame:
    """``(keys, term, weight)``: the sum of p tf / dl over the kept terms of the feedback documents, or all of them if ``whole``."""
    if whole:
        # The feedback goes to the divisions; postings stay and aren't sorted.
        held = index.postings.select("term", "ord", "tf", "dl").join(feedback.hint("shuffle_hash"), "ord")
        return held.groupBy(*keys, "term").agg(F.sum(F.col("p") * F.col("tf") / F.col("dl")).alias("weight"))
    held = feedback.join(index.lists, "ord").select(*keys, "p", "dl", F.explode("terms").alias("t")).select(*keys, "p", "dl", "t.*")
    return held.groupBy(*keys, "term").agg(F.sum(F.col("p") * F.col("tf") / F.col("dl")).alias("weight"))


def expansion_terms(model: DataFrame, index: Index, fb_terms: Column | int = FB_TERMS, min_idf: float = MIN_IDF, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``(keys, term, weight)``: the strongest terms of an idf of at least ``min_idf``, ties by term."""
    known = model.join(index.terms.select("term", bm25_idf(index).alias("idf")), "term").where(F.col("idf") >= min_idf)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("weight", 9)), F.asc("term"))
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fb_terms).select(*keys, "term", "weight")


def mixed_weights(weights: DataFrame, kept: DataFrame, alpha: Column | float = ALPHA, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``(keys, term, weight, expanded)`` of all queries.

    An expanded query has original and expansion terms, each side of weight 1,
    mixed by ``alpha``; one without an expansion keeps its weights.
    """
    by_query = Window.partitionBy(*keys)
    own = weights.select(*keys, "term", F.col("weight").alias("plain"), (F.col("weight") / F.sum("weight").over(by_query)).alias("own"))
    more = kept.select(*keys, "term", (F.col("weight") / F.sum("weight").over(by_query)).alias("more"))
    both = own.join(more, [*keys, "term"], "full").withColumn("expanded", F.max(F.col("more").isNotNull()).over(by_query))
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    mixed = alpha * F.coalesce("own", F.lit(0.0)) + (1 - alpha) * F.coalesce("more", F.lit(0.0))
    return both.select(*keys, "term", F.when(F.col("expanded"), mixed).otherwise(F.col("plain")).alias("weight"), "expanded")


def expanded_queries(weights: DataFrame, kept: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``(qid, term, weight)`` of the queries that have an expansion; a query's weights add up to 1."""
    return mixed_weights(weights, kept, alpha).where("expanded").drop("expanded")


def rm3(
    queries: DataFrame, index: Index, k: int = 10, k1: float = ENTRY_K1, b: float = ENTRY_B,
    fb_docs: int = FB_DOCS, fb_terms: int = FB_TERMS, alpha: float = ALPHA, min_idf: float = MIN_IDF, whole: bool = False,
) -> DataFrame:
    """Two-pass ranking with a column ``expanded``; ``whole`` takes all terms of the feedback documents.

    A query that has nothing to expand with keeps its first-pass ranking, whose
    scores are on another scale; ``expanded`` tells them apart.
    """
    weights, askers = distinct_queries(queries, index)
    feedback = feedback_of(bm25_best(weights, index, fb_docs, k1, b), fb_docs)
    kept = expansion_terms(relevance_model(feedback, index, whole=whole), index, fb_terms, min_idf)
    best = bm25_best(mixed_weights(weights, kept, alpha), index, k, k1, b, ("qid", "expanded"))
    return answered(named(best, index), askers)


# Result shaping


def filler_order(index: Index, first: int) -> DataFrame:
    """``(ord, doc_id, place)`` of the ``first`` longest documents, place from 0, ties by ``ord``."""
    longest = index.docs.orderBy(F.desc("dl"), F.asc("ord")).limit(first)
    return longest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("dl"), F.asc("ord"))) - 1)  # `first` rows


def fill_to_k(ranked: DataFrame, queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """Rankings padded to ``k`` with the longest documents not in them.

    A filler's score is the lowest real score (1 without any) / 10^6 less its
    place among all documents by length / 10^9.  At most 2k of the longest are
    ever needed, as k of them at most are taken already.
    """
    real = written(ranked.select("qid", "ord", "doc_id", "score", "rank"), "ranked")  # k rows a query, read three times
    state = queries.select("qid").distinct().join(real.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor")), "qid", "left")
    short = state.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("floor", F.lit(1.0)).alias("floor")).where(F.col("n") < k)
    longest = filler_order(index, 2 * k).collect()  # 2k rows
    kind = index.docs.schema["doc_id"].dataType
    fillers = [F.struct(F.lit(r["ord"]).cast("bigint").alias("ord"), F.lit(r["doc_id"]).cast(kind).alias("doc_id"), F.lit(r["place"]).alias("place")) for r in longest]
    if not fillers:
        return real
    offered = short.select("qid", "n", "floor", F.explode(F.array(*fillers)).alias("f")).select("qid", "n", "floor", "f.*")
    free = offered.join(real.select("qid", "ord"), ["qid", "ord"], "left_anti")
    free = free.withColumn("rank", F.col("n") + F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("rank") <= k)
    score = F.col("floor") * 1e-6 - F.col("place") * 1e-9
    return real.unionByName(free.select("qid", "ord", "doc_id", score.alias("score"), F.col("rank").cast("int").alias("rank")))


def run_faults(run: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, qid, n, docs)`` of the queries that have more than ``k`` rows or a document twice."""
    sizes = run.groupBy(*by, "qid").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return sizes.where((F.col("n") > k) | (F.col("docs") < F.col("n")))


def checked_run(run: DataFrame, k: int) -> DataFrame:
    """``run`` itself, if every query has at most ``k`` rows and no document twice; else an error."""
    bad = run_faults(run, k).head(1)
    if bad:
        raise ValueError(f"query {bad[0]['qid']} has {bad[0]['n']} rows of {bad[0]['docs']} documents, {k} at most are allowed")
    return run


def retrieve(queries: DataFrame, index: Index, k: int = 10, scorer: str = "bm25", k1: float = ENTRY_K1, b: float = ENTRY_B, use_rm3: bool = False, fill: bool = True) -> DataFrame:
    """Rankings by ``vsm``, ``custom`` (RM3 where ``use_rm3``) or, for any other name, BM25; filled to ``k``."""
    if scorer == "vsm":
        ranked = top_k(vsm_scores(queries, index), index, k)
    elif scorer == "custom" and use_rm3 and index.forward_terms:
        ranked = rm3(queries, index, k, k1, b).drop("expanded")
    else:
        ranked = bm25(queries, index, k, k1, b)
    return fill_to_k(ranked, queries, index, k) if fill else ranked
