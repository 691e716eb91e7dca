"""The registered queries over the tables of a directory.

Tables as collected are not clean: records, topics, judgments and run rows are
repeated.  The first functions here fix what counts: the first row of a record,
one text per topic, the latest grade that isn't null, and run rows with all of
topic, system, document and score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.porter import stem_column
from tessera.functions.text import boost_title, tokenize
from tessera.operators import codec
from tessera.operators import evaluation as ev
from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer, analyze, spread
from tessera.operators.index import Index, build_index, first_rows
from tessera.plans import experiments as ex
from tessera.scratch import new_path, written
from tessera.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_indexes: dict[tuple, Index] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, ord, text)``: the first row of every record; a null text is empty."""
    first = _read(spark, folder, "corpus").groupBy("doc_id").agg(F.min(F.struct("ord", "text")).alias("r"))
    return first.select("doc_id", "r.ord", F.coalesce("r.text", F.lit("")).alias("text"))


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """``(qid, text)``: the smallest text of a topic that isn't null, else empty."""
    return _read(spark, folder, "queries_dev").groupBy("qid").agg(F.coalesce(F.min("query_text"), F.lit("")).alias("text"))


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """``(qid, doc_id, rel)``: the latest grade that isn't null, of equally late ones the highest."""
    graded = _read(spark, folder, "qrels").where("rel is not null")
    return graded.groupBy("qid", "doc_id").agg(F.max(F.struct("judged_at", "rel")).getField("rel").alias("rel"))


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_tag, qid, doc_id, score, rank)``: usable rows ranked by score, repeated documents included."""
    rows = _read(spark, folder, "dev_run").select("run_tag", "qid", "doc_id", "score").dropna().where(~F.isnan("score"))
    order = Window.partitionBy("run_tag", "qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order))


def index_of(spark: SparkSession, folder: str, analyzer: Analyzer = Analyzer()) -> Index:
    """The index of the collection, built once per session, folder and analyzer."""
    key = (spark.sparkContext.applicationId, folder, analyzer)
    if key not in _indexes:
        rows = first_rows(spread(_read(spark, folder, "corpus").select("ord", "doc_id", "text")), "doc_id", "ord")
        _indexes[key] = build_index(rows, analyzer)
    return _indexes[key]


SYSTEM = ("run_tag",)
ENTRY = Analyzer(title_boost=rk.ENTRY_TITLE_BOOST)


#: Ranks are given as the type that window functions have in SQL.
RANK = "cast(rank as bigint) as rank"


def _ranked(df: DataFrame) -> DataFrame:
    return df.selectExpr("qid", "doc_id", "round(score, 4) as score", RANK)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _means(df: DataFrame) -> DataFrame:
    """Metrics to six digits; the nudge keeps engines together on means that lie half way."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ev.METRICS})


def _bm25(spark: SparkSession, folder: str, analyzer: Analyzer = Analyzer(), k1: float = rk.K1, b: float = rk.B) -> DataFrame:
    return rk.bm25(topics(spark, folder), index_of(spark, folder, analyzer), 10, k1, b)


# Analysis


@_query
def tokenize_counts(spark, folder):
    rows = collection(spark, folder).select("doc_id", tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_types"))


@_query
def stopword_filter_counts(spark, folder):
    kept = F.size(Analyzer(stemming=False).tokens(F.col("text")))
    rows = collection(spark, folder).select("doc_id", F.size(tokenize(F.col("text"))).cast("bigint").alias("n_tokens"), kept.cast("bigint").alias("n_kept"))
    return rows.where("n_tokens > 0")


@_query
def title_boost_tokens(spark, folder):
    tokens = collection(spark, folder).select("doc_id", F.explode(tokenize(boost_title(F.col("text"), 2))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@_query
def porter_stem_vocab(spark, folder):
    words = collection(spark, folder).select(F.explode(tokenize(F.col("text"))).alias("token")).distinct()
    return words.select("token", stem_column("token").alias("term"))


@_query
def analyze_terms(spark, folder):
    return analyze(collection(spark, folder), "ord", "text").select("ord", F.col("pos").cast("bigint").alias("pos"), "term")


# Index


@_query
def postings(spark, folder):
    return index_of(spark, folder).postings.select("term", "ord", "tf")


@_query
def doc_lengths(spark, folder):
    return index_of(spark, folder).docs.select("doc_id", "dl")


@_query
def dictionary_df(spark, folder):
    index = index_of(spark, folder)
    return index.terms.join(index.term_ids(), "term").select("term", "df", "cf", "term_id")


@_query
def collection_stats(spark, folder):
    return _rounded(index_of(spark, folder).stats(), "mean_length")


@_query
def term_rank_by_df(spark, folder):
    return index_of(spark, folder).frequency_ranks()


@_query
def forward_index_top24(spark, folder):
    return index_of(spark, folder).forward.selectExpr("ord", "term", "tf", RANK)


@_query
def document_frequency_lookup(spark, folder):
    """Document frequency of every blank-separated word of the topics."""
    words = topics(spark, folder).select(F.explode(F.split("text", " ")).alias("word"))
    return index_of(spark, folder).document_frequency(words)


@_query
def postings_lookup(spark, folder):
    """Postings of every term of the topics."""
    index = index_of(spark, folder)
    asked = index.analyzed(topics(spark, folder)).groupBy("term").agg(F.min("term").alias("qid"))
    return rk.matching_postings(asked, index, F.col("tf")).select(F.col("qid").alias("term"), "ord", "tf")


@_query
def forward_lookup(spark, folder):
    """Kept terms of the judged documents."""
    index = index_of(spark, folder)
    asked = index.docs.join(judgments(spark, folder).select("doc_id").distinct(), "doc_id", "left_semi").select("ord", "doc_id")
    return asked.join(index.forward, "ord").select("doc_id", "term", "tf")


# Ranking


@_query
def boolean_and(spark, folder):
    index = index_of(spark, folder)
    return rk.boolean_ids(topics(spark, folder), index, "and")


@_query
def boolean_or(spark, folder):
    index = index_of(spark, folder)
    return rk.boolean_ids(topics(spark, folder), index, "or")


@_query
def vsm_doc_norms(spark, folder):
    return _rounded(rk.vsm_norms(index_of(spark, folder)), "norm")


@_query
def vsm_top10(spark, folder):
    index = index_of(spark, folder)
    return _ranked(rk.top_k(rk.vsm_scores(topics(spark, folder), index), index, 10))


@_query
def bm25_idf(spark, folder):
    index = index_of(spark, folder)
    return index.terms.select("term", "df", F.round(rk.bm25_idf(index), 6).alias("idf"))


@_query
def bm25_impacts(spark, folder):
    return _rounded(rk.bm25_impacts(index_of(spark, folder)), "impact")


@_query
def bm25_top10(spark, folder):
    return _ranked(_bm25(spark, folder))


@_query
def bm25_top10_nostem(spark, folder):
    return _ranked(_bm25(spark, folder, Analyzer(stemming=False)))


@_query
def bm25_title2_top10(spark, folder):
    """The default configuration of the entry point."""
    return _ranked(_bm25(spark, folder, ENTRY, rk.ENTRY_K1, rk.ENTRY_B))


@_query
def bm25_k1_zero(spark, folder):
    return _ranked(_bm25(spark, folder, k1=0.0))


@_query
def bm25_b_zero(spark, folder):
    return _ranked(_bm25(spark, folder, b=0.0))


def _feedback(spark, folder):
    index = index_of(spark, folder)
    weights, askers = rk.distinct_queries(topics(spark, folder), index)
    return index, weights, askers, rk.feedback_of(rk.bm25_best(weights, index, rk.FB_DOCS, rk.ENTRY_K1, rk.ENTRY_B))


@_query
def rm3_feedback_weights(spark, folder):
    _, _, askers, feedback = _feedback(spark, folder)
    return _rounded(rk.answered(feedback, askers), "p")


@_query
def rm3_relevance_model(spark, folder):
    """The terms kept for expansion, of all terms of the feedback documents."""
    index, _, askers, feedback = _feedback(spark, folder)
    return _rounded(rk.answered(rk.expansion_terms(rk.relevance_model(feedback, index, whole=True), index), askers), "weight")


@_query
def rm3_expanded_query(spark, folder):
    index, weights, askers, feedback = _feedback(spark, folder)
    return _rounded(rk.answered(rk.expanded_queries(weights, rk.expansion_terms(rk.relevance_model(feedback, index, whole=True), index)), askers), "weight")


@_query
def rm3_top10(spark, folder):
    ranked = rk.rm3(topics(spark, folder), index_of(spark, folder), whole=True)
    return ranked.selectExpr("qid", "doc_id", "round(score, 4) as score", RANK, "expanded")


# Shaping and files


@_query
def fill_to_k(spark, folder):
    return _ranked(rk.retrieve(topics(spark, folder), index_of(spark, folder, ENTRY)))


@_query
def validate_run_duplicates(spark, folder):
    """Queries of the given runs that a check refuses: over 100 rows, or a document twice."""
    return rk.run_faults(run_rows(spark, folder), 100, SYSTEM)


@_query
def trec_run_lines(spark, folder):
    """Lines of the default ranking, scores cut to the four digits on which engines agree."""
    ranked = _ranked(_bm25(spark, folder, ENTRY, rk.ENTRY_K1, rk.ENTRY_B))
    lines = files.run_lines(ranked, "tessera")
    return lines.withColumn("value", F.regexp_replace("value", r"(\.\d{4})\d{2} ", "$1 ")).selectExpr("qid", RANK, "value")


@_query
def trec_run_roundtrip(spark, folder):
    """Every system's rows written as a run file of its own and read again."""
    path = new_path(spark, "runs")
    files.write_runs(run_rows(spark, folder), path, "run_tag", "tessera")
    return files.read_runs(spark, path, "run_tag").selectExpr("run_tag", "qid", "doc_id", RANK)


@_query
def qrels_parse(spark, folder):
    path = new_path(spark, "qrels")
    judgments(spark, folder).select(F.format_string("%s 0 %s %d", "qid", "doc_id", "rel").alias("value")).write.text(path)
    return files.read_qrels(spark, path)


@_query
def queries_parse(spark, folder):
    path = new_path(spark, "topics")
    topics(spark, folder).select(F.concat_ws("\t", "qid", F.translate("text", "\n", " ")).alias("value")).write.text(path)
    return files.read_queries(spark, path)


# Metrics


def _all_runs(spark, folder):
    return run_rows(spark, folder).select("run_tag", "qid", "doc_id", "rank")


def _metric(name: str, column: str) -> None:
    def f(spark, folder):
        per = ev.per_query_metrics(_all_runs(spark, folder), judgments(spark, folder), by=SYSTEM)
        return per.select("run_tag", "qid", F.round(column, 6).alias(column))

    QUERIES[name] = f


for _name, _column in (("ndcg_at_10", "ndcg_10"), ("map_at_10", "map_10"), ("mrr", "mrr"), ("precision_at_10", "p_k")):
    _metric(_name, _column)


@_query
def dedup_keep_first(spark, folder):
    return ev.dedup_keep_first(_all_runs(spark, folder), SYSTEM).selectExpr("run_tag", "qid", "doc_id", RANK)


@_query
def evaluate_run_aggregate(spark, folder):
    return _means(ev.evaluate_run(_all_runs(spark, folder), judgments(spark, folder), by=SYSTEM))


@_query
def skipped_no_qrels(spark, folder):
    return ev.skipped_queries(topics(spark, folder), judgments(spark, folder))


@_query
def provisional_score(spark, folder):
    runs = run_rows(spark, folder).select("run_tag", "qid", "doc_id", "rank")
    rows = ev.evaluate_run(runs, judgments(spark, folder), by=("run_tag",))
    return rows.select("run_tag", F.round(ev.provisional_score(F.col("ndcg_10"), F.col("map_10")), 6).alias("provisional"))


def _costs(spark, folder):
    """Rows and topics of each system, standing for its build and query cost, with the medians."""
    costs = run_rows(spark, folder).groupBy("run_tag").agg(F.count("*").cast("double").alias("build"), F.countDistinct("qid").cast("double").alias("latency"))
    costs = written(costs, "costs")
    median = costs.agg(F.median("build"), F.median("latency")).first()
    return costs, F.lit(median[0]), F.lit(median[1])


@_query
def efficiency_modifier(spark, folder):
    costs, build, latency = _costs(spark, folder)
    return costs.select("run_tag", F.round(ev.efficiency_modifier(F.col("build"), F.col("latency"), build, latency), 6).alias("modifier"))


@_query
def index_size_score(spark, folder):
    costs, size, _ = _costs(spark, folder)
    return costs.select("run_tag", F.round(ev.index_size_score(F.col("build"), size), 6).alias("size_score"))


@_query
def beats_baseline(spark, folder):
    qrels = judgments(spark, folder)
    own, base = (ev.evaluate_run(_bm25(spark, folder, k1=k1, b=b), qrels) for k1, b in ((1.5, 0.75), (0.9, 0.4)))
    row = ev.summarize(own, base)
    return _rounded(row, *(c for c in row.columns if not c.startswith("beats")))


# Codec


@_query
def dgap_postings(spark, folder):
    return codec.gaps(index_of(spark, folder).postings).select("term", "ord", "gap", "tf")


@_query
def vbyte_widths(spark, folder):
    widths = codec.gaps(index_of(spark, folder).postings).select(codec.byte_width(F.col("gap")).alias("width"))
    return widths.groupBy("width").agg(F.count("*").alias("n"))


@_query
def vbyte_encode_bytes(spark, folder):
    return codec.gaps(index_of(spark, folder).postings).select("term", "ord", F.array_join(codec.encode_number(F.col("gap")).cast("array<string>"), " ").alias("bytes"))


@_query
def vbyte_roundtrip(spark, folder):
    again = codec.decode(codec.encode(F.array("gap")))
    return codec.gaps(index_of(spark, folder).postings).select("term", "ord", again[0].alias("gap"))


@_query
def gap_tf_flag_streams(spark, folder):
    """The streams of every block of documents as text."""
    blocks = codec.encode_streams(index_of(spark, folder).postings, 256)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return blocks.select("term", F.col("block").cast("bigint").alias("block"), text("gap_stream"), text("tf_stream"))


@_query
def interleaved_streams(spark, folder):
    """The interleaved stream of every block of documents as text."""
    blocks = codec.encode_interleaved(index_of(spark, folder).postings, 256)
    return blocks.select("term", F.col("block").cast("bigint").alias("block"), F.array_join(F.col("data").cast("array<string>"), " ").alias("data"))


@_query
def gap_stream_decode(spark, folder):
    return codec.decode_streams(codec.encode_streams(index_of(spark, folder).postings, 256))


@_query
def interleaved_decode(spark, folder):
    return codec.decode_interleaved(codec.encode_interleaved(index_of(spark, folder).postings, 256))


# Experiments


def _sweep(spark, folder, points):
    return ex.bm25_sweep(topics(spark, folder), index_of(spark, folder), judgments(spark, folder), points)


@_query
def sweep_k1(spark, folder):
    return _means(_sweep(spark, folder, [(k1, 0.75) for k1 in ex.K1_GRID]))


@_query
def sweep_b(spark, folder):
    return _means(_sweep(spark, folder, [(1.2, b) for b in ex.B_GRID]))


@_query
def grid_best(spark, folder):
    points = [(k1, b) for k1 in ex.JOINT_K1 for b in ex.JOINT_B]
    return ex.best_setting(_means(_sweep(spark, folder, points)))


@_query
def model_comparison(spark, folder):
    index, asked = index_of(spark, folder), topics(spark, folder)
    qrels = judgments(spark, folder)
    asked = ex.judged_queries(asked, qrels)
    runs = {"vsm": rk.vsm(asked, index), "bm25": rk.bm25(asked, index), "rm3": rk.rm3(asked, index)}
    return _means(ex.compare_models(runs, qrels))


def _grid(spark, folder):
    key = (spark.sparkContext.applicationId, folder, "rm3-grid")
    if key not in _indexes:
        grid = ex.rm3_grid(topics(spark, folder), index_of(spark, folder), judgments(spark, folder))
        _indexes[key] = written(grid.select(*ex.RM3_KEYS, "qid", "ndcg_10"), "rm3-grid")
    return _indexes[key]


@_query
def rm3_cv_folds(spark, folder):
    """Five folds of the judged topics: the setting that the others choose, its nDCG and that of plain BM25."""
    plain = rk.bm25(topics(spark, folder), index_of(spark, folder), 10, 2.0, 0.6)
    baseline = ev.per_query_metrics(plain, judgments(spark, folder))
    return _rounded(ex.cross_validate(_grid(spark, folder), baseline), "train_ndcg", "held_out_ndcg", "baseline_ndcg")


@_query
def rm3_robust_pick(spark, folder):
    return _rounded(ex.robust_settings(_grid(spark, folder)), "worst_fold", "mean_ndcg").selectExpr("* except (place)", "cast(place as bigint) as place")


def _datasets(spark, folder):
    """The collection with and without the title's weight; the tables hold only one collection that has judgments."""
    asked, qrels = topics(spark, folder), judgments(spark, folder)
    return ex.cross_dataset({"plain": (asked, index_of(spark, folder), qrels), "titled": (asked, index_of(spark, folder, ENTRY), qrels)})


@_query
def cross_dataset_table(spark, folder):
    """nDCG and MAP of every configuration on every dataset."""
    return _rounded(_datasets(spark, folder), "ndcg_10", "map_10")


@_query
def cross_dataset_summary(spark, folder):
    return _rounded(ex.cross_dataset_summary(_datasets(spark, folder)), "mean_ndcg", "worst_ndcg")


@_query
def dataset_stats(spark, folder):
    return ex.dataset_stats(topics(spark, folder), index_of(spark, folder), judgments(spark, folder))


def _analysis(spark, folder, whole=False):
    rows = ex.error_analysis(topics(spark, folder), index_of(spark, folder), judgments(spark, folder), whole=whole)
    lists = {c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("query_terms", "top_grades", "expansion")}
    return _rounded(rows.withColumns(lists), "ndcg_bm25", "ndcg_rm3", "delta")


@_query
def error_analysis_per_query(spark, folder):
    return _analysis(spark, folder, whole=True)


@_query
def rm3_worst_topics(spark, folder):
    """The ten topics of the lowest nDCG."""
    return ex.worst_queries(_analysis(spark, folder), 10)


@_query
def rm3_regressions(spark, folder):
    """The ten topics that lose most by expansion."""
    return ex.worst_queries(_analysis(spark, folder), 10, "delta")


@_query
def run_report(spark, folder):
    """The JSON report of every system's run, read again: means, number of queries, and queries with a relevant document on top."""
    per = written(ev.per_query_metrics(_all_runs(spark, folder), judgments(spark, folder), by=SYSTEM), "per-query")
    text = files.report(ev.aggregate_metrics(per, SYSTEM), per, SYSTEM)
    kinds = "aggregate_metrics struct<ndcg_10:double,map_10:double,mrr:double,p_k:double,num_queries:bigint>, per_query_metrics map<string,struct<mrr:double>>"
    rows = text.select("run_tag", F.from_json("value", kinds).alias("r"))
    hits = F.size(F.filter(F.map_values("r.per_query_metrics"), lambda m: m["mrr"] == 1)).cast("bigint").alias("first_relevant")
    return _means(rows.select("run_tag", "r.aggregate_metrics.*", F.size("r.per_query_metrics").cast("bigint").alias("listed"), hits))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
