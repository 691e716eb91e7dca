"""Collections, topics, judgments, runs and reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, at)``: lines that aren't blank; ``at`` sorts by file name, place of the split in its file, and line."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    return rows.select("value", F.struct("file", "start", F.monotonically_increasing_id().alias("line")).alias("at"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, ord)``: lines that aren't blank, numbered from 0 over all files in order of name.

    One pass counts the lines of every split; what joins is one row per split.
    """
    lines = _lines(spark, path)
    splits = lines.groupBy("at.file", "at.start").agg(F.min("at.line").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    placed = lines.select("value", "at.file", "at.start", "at.line").join(F.broadcast(splits), ["file", "start"])
    return placed.select("value", (F.col("offset") + F.col("line")).alias("ord"))


def _fields(line: Column, n: int, what: str) -> Column:
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"not {n} fields of a {what}: "), line)).cast("array<string>"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, doc_id, text)`` of a JSON-lines collection; a line without doc_id or text is an error.

    ``ord`` is the place among the lines of all files, in order of file name.
    """
    parsed = _numbered_lines(spark, path).select("ord", F.from_json("value", "doc_id STRING, text STRING", {"mode": "FAILFAST"}).alias("r"))
    need = lambda c: F.coalesce(F.col(f"r.{c}"), F.raise_error(F.lit(f"a line has no {c}")).cast("string"))
    return parsed.select("ord", need("doc_id").alias("doc_id"), need("text").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)``: cut at the first tab only, the rest as it is; a line without a tab is an error."""
    return parse_queries(_lines(spark, path).select("value"))


def parse_queries(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t", 2)
    parts = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("no tab in the topic: "), F.col("value"))).cast("array<string>"))
    return lines.select(parts.alias("p")).select(F.col("p")[0].alias("qid"), F.col("p")[1].alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id, rel)`` of lines of four fields; of repeated pairs the last line counts."""
    return parse_qrels(_lines(spark, path))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """The same of ``(value, at)``."""
    f = lines.select(_fields(F.col("value"), 4, "judgment").alias("f"), "at")
    rows = f.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rel"), "at")
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "at").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id, score, rank, tag)`` of lines of six fields.

    The rank in the file is ignored: rows are ranked by descending score, ties in file order.
    """
    return parse_run(_lines(spark, path))


def parse_run(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same of ``(by, value, at)``, each value of ``by`` being a run of its own."""
    f = lines.select(*by, _fields(F.col("value"), 6, "run").alias("f"), "at")
    rows = f.select(*by, F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag"), "at")
    order = Window.partitionBy(*by, "qid").orderBy(F.desc("score"), F.asc("at"))
    return rows.select(*by, "qid", "doc_id", "score", F.row_number().over(order).alias("rank"), "tag")


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """``(qid, rank, value)``: the line of every row of a run."""
    return run.select("qid", "rank", run_lines_column(tag).alias("value"))


def run_lines_column(tag: str) -> Column:
    return F.format_string(f"%s Q0 %s %d %.6f {tag}", "qid", "doc_id", F.col("rank").cast("bigint"), F.col("score").cast("double"))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    """Write a run in order of query and rank."""
    run_lines(run, tag).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def write_runs(runs: DataFrame, path: str, by: str, tag: str) -> None:
    """Write the run of every value of ``by`` to a folder of its own, all in one job."""
    lines = runs.select(by, "qid", "rank", run_lines_column(tag).alias("value"))
    lines.repartitionByRange(by, "qid").sortWithinPartitions(by, "qid", "rank").select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def read_runs(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``(by, qid, doc_id, score, rank, tag)`` of ``write_runs``."""
    rows = spark.read.schema(f"value string, {by} string").text(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")
    return parse_run(rows.where(F.trim("value") != "").select(by, "value", at), (by,))


def report(aggregate: DataFrame, per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, value)``: per value of ``by`` (one row without) a nested report as JSON, of aggregate metrics and a row per query.

    A row's size is that of the topic set, which people judge by hand.
    """
    names = [c for c in per_query.columns if c not in ("qid", *by)]
    entry = F.struct("qid", F.struct(*names).alias("m"))
    queries = per_query.groupBy(*by, F.lit(1).alias("one")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("per_query_metrics"))
    whole = aggregate.select(*by, F.lit(1).alias("one"), F.struct(*(c for c in aggregate.columns if c not in by)).alias("aggregate_metrics"))
    return whole.join(queries, [*by, "one"]).select(*by, F.to_json(F.struct("aggregate_metrics", "per_query_metrics")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """Write a result table as JSON lines."""
    df.write.mode("overwrite").json(path)


def directory_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, on whichever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
