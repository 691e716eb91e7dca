"""The inverted index as Parquet tables, its build, persistence and lookups."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.analysis import Analyzer, counted_terms, query_terms
from tessera.scratch import delete, forget, new_path, shuffles_freed, written

FORMAT_VERSION = 3
#: Fixed value: terms per document that the forward index keeps by default.
FORWARD_TERMS = 24
#: Postings of a division of the documents, the unit of a scoring task, and of a bucket of terms, the unit of pruning.
DIVISION_POSTINGS, BUCKET_POSTINGS = 8_000_000, 250_000
#: Divisions at most (a limit of Spark), and buckets of terms, which a batch names by the bits of one number.
MOST_DIVISIONS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 4, 63
#: Rows of terms that are sent to every task; of a larger vocabulary only the terms that this many documents hold.
BROADCAST_TERMS, HOT_TERM = 500_000, 1_000_000
_TABLES = ("docs", "terms", "lists")


@dataclass(frozen=True)
class Index:
    """An immutable index.

    ``docs(ord, doc_id, dl, norm)``, ``terms(term, df, cf, key)``, ``postings(bucket,
    term, ord, tf, dl, df)``, ``lists(ord, dl, terms)`` with the kept terms of
    every document.  Documents without a term are in ``docs`` with length 0;
    ``norm`` is the length of the document's (1 + log10 tf) idf vector, 1 where
    that is 0; ``key`` is a number per term without an order.

    Postings are divided by document (buckets of ``ord``), so what is grouped by
    document needs no shuffle, and within that by a hash of the term, so a
    batch reads the buckets of its terms only.
    """

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    lists: DataFrame
    analyzer: Analyzer
    forward_terms: int
    n_docs: int
    total_length: int
    divisions: int
    buckets: int
    tables: tuple[str, ...] = field(default=(), compare=False)
    folder: str = field(default="", compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def mean_length(self) -> float:
        """Over all documents, empty ones included; 0.0 for an empty collection."""
        return self.total_length / self.n_docs if self.n_docs else 0.0

    @property
    def length_unit(self) -> float:
        """What lengths are divided by: the mean, or 1 where that is 0."""
        return self.mean_length or 1.0

    @property
    def forward(self) -> DataFrame:
        """``(ord, term, tf, rank, dl)``: the kept terms of every document, ``rank`` from 1."""
        return self.lists.select("ord", "dl", F.posexplode("terms").alias("at", "t")).select("ord", "t.term", "t.tf", (F.col("at") + 1).alias("rank"), "dl")

    def stats(self) -> DataFrame:
        """One row: number of documents, total and mean length, vocabulary size."""
        size = self.terms.agg(F.count("*").alias("n_terms"))
        return size.select(F.lit(self.n_docs).cast("bigint").alias("n_docs"), F.lit(self.total_length).cast("bigint").alias("total_length"), F.lit(self.mean_length).alias("mean_length"), "n_terms")

    def analyzed(self, queries: DataFrame) -> DataFrame:
        """``(qid, term, qtf)`` of ``(qid, text)``, by the index's own analyzer."""
        return query_terms(queries, self.analyzer)

    def document_frequency(self, words: DataFrame) -> DataFrame:
        """``(word, df)`` of a column ``word``; 0 unless the word is exactly one known term."""
        asked = words.select("word").distinct()
        found = self.analyzed(asked.select(F.col("word").alias("qid"), F.col("word").alias("text")))
        single = found.groupBy("qid").agg(F.sum("qtf").alias("n"), F.first("term").alias("term")).where("n = 1")
        known = single.join(self.terms, "term").select(F.col("qid").alias("word"), "df")
        return asked.join(known, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms; both the bucket and the term reach the scan."""
        buckets = self.spark.createDataFrame([(t,) for t in terms], "term string").select(term_bucket(F.col("term"), self.buckets)).distinct()
        held = self.postings.where(F.col("bucket").isin([r[0] for r in buckets.collect()]) & F.col("term").isin(terms))
        return held.select("term", "ord", "tf")

    def forward_of(self, ords: list[int]) -> DataFrame:
        """Kept terms of a few documents, in order of term."""
        return self.forward.where(F.col("ord").isin(ords)).select("ord", "term", "tf").orderBy("ord", "term")

    def term_ids(self) -> DataFrame:
        """``(term, term_id)`` in byte order from 0, for exchange with systems that number terms.

        Numbers come from one offset per range partition, so no task sorts the whole vocabulary.
        """
        return _numbered(self.terms.select("term"), [F.col("term").asc()], "term_id")

    def frequency_ranks(self) -> DataFrame:
        """``(term, df, df_rank)``: place from 0 by descending df, then by term."""
        return _numbered(self.terms.select("term", "df"), [F.col("df").desc(), F.col("term").asc()], "df_rank")

    def save(self, path: str) -> None:
        """Write the index to a folder.  A doc_id with a line break is refused, as run files could not hold it."""
        if self.docs.where(F.col("doc_id").cast("string").rlike(r"[\r\n]")).head(1):
            raise ValueError("a doc_id holds a line break")
        for name in _TABLES:
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        delete(self.spark, f"{path}/postings")
        self.spark.sql(f"drop table {_divided(self.postings, f'{path}/postings', self.divisions)}")
        meta = {"version": FORMAT_VERSION, "n_docs": self.n_docs, "total_length": self.total_length, "forward_terms": self.forward_terms, "divisions": self.divisions, "buckets": self.buckets}
        meta |= {"doc_id": self.docs.schema["doc_id"].dataType.simpleString(), "analyzer": asdict(self.analyzer)}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """Read a saved index; another format version is refused."""
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        if meta["version"] != FORMAT_VERSION:
            raise ValueError(f"index format {meta['version']}, not {FORMAT_VERSION}")
        name = _table_name()
        spark.sql(
            f"create table {name} (term string, ord bigint, tf bigint, dl bigint, df bigint, bucket int) using parquet options (path '{path}/postings') "
            f"partitioned by (bucket) clustered by (ord) sorted by (term, ord) into {meta['divisions']} buckets"
        )
        spark.sql(f"alter table {name} recover partitions")
        read = {t: spark.read.parquet(f"{path}/{t}") for t in _TABLES}
        kept = {k: meta[k] for k in ("forward_terms", "n_docs", "total_length", "divisions", "buckets")}
        return Index(**read, postings=spark.table(name), analyzer=Analyzer(**meta["analyzer"]), tables=(name,), **kept)

    def close(self) -> None:
        """Forget the index's tables and delete what its build wrote to the scratch folder; a saved copy stays."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        if self.folder:
            forget(self.spark, self.folder)


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _table_name() -> str:
    return f"tessera_postings_{uuid.uuid4().hex}"


def _divided(postings: DataFrame, path: str, divisions: int) -> str:
    """Write postings divided by document and bucket of term; the name of the table."""
    name = _table_name()
    rows = postings.select("term", "ord", "tf", "dl", "df", "bucket").repartition(divisions, "ord")
    with shuffles_freed(postings.sparkSession):
        rows.write.partitionBy("bucket").bucketBy(divisions, "ord").sortBy("term", "ord").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place from 0 in a total order: range partitions, then one offset each."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.select(*df.columns, (F.col("offset") + F.col("at") - F.shiftleft(F.col("part"), 33)).alias(name))


def with_frequencies(rows: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``rows`` joined with ``terms(term, df, ...)`` by term without a hot key.

    A vocabulary of up to ``BROADCAST_TERMS`` rows is sent to every task.  Of a
    larger one only the terms are that ``HOT_TERM`` documents hold, of which
    there are no more than rows / ``HOT_TERM``; the others are joined by
    shuffle, where no key has more than ``HOT_TERM`` rows.
    """
    if n_terms <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), "term")
    hot = terms.where(F.col("df") >= HOT_TERM)
    if hot.count() > BROADCAST_TERMS:
        return rows.join(terms, "term")
    cold = rows.join(F.broadcast(hot.select("term")), "term", "left_anti").join(terms.where(F.col("df") < HOT_TERM), "term")
    return cold.unionByName(rows.join(F.broadcast(hot), "term"))


def vsm_idf(n_docs: int) -> Column:
    return F.log10(F.lit(float(n_docs)) / F.greatest(F.col("df"), F.lit(1)))


def document_norms(docs: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``docs`` with ``norm``; postings are divided by document, so only one number per document moves."""
    square = F.pow((1 + F.log10("tf")) * vsm_idf(n_docs), F.lit(2.0))
    norms = postings.groupBy("ord").agg(F.sqrt(F.sum(square)).alias("norm"))
    return docs.join(norms, "ord", "left").withColumn("norm", F.when(F.coalesce("norm", F.lit(0.0)) > 0, F.col("norm")).otherwise(1.0))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the smallest ``order`` (unique) of every ``key``, the others' being few or many.

    Only ``key`` and ``order`` are shuffled to find the later rows; up to
    ``BROADCAST_TERMS`` of them are then left out where they are read, and only
    more than that move the rows themselves.
    """
    firsts = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.select(key, order).join(firsts, key).where(F.col(order) > F.col("first")).select(order)
    later = written(later, "later-rows")
    return rows.join(F.broadcast(later) if later.count() <= BROADCAST_TERMS else later, order, "left_anti")


def build_index(corpus: DataFrame, analyzer: Analyzer = Analyzer(), forward_terms: int = FORWARD_TERMS) -> Index:
    """Index of ``(ord, doc_id, text)``, ``ord`` being the unique order of documents.

    A null text counts as empty.  A repeated doc_id is refused.  ``forward_terms``
    bounds the forward index per document, by descending count, ties to the term
    that occurs first; 0 leaves it empty.

    Texts are read once and never moved: a document's terms are counted in its
    row.  What is shuffled are postings, once, to their division, and the
    partial counts of the terms.
    """
    spark = corpus.sparkSession
    folder = new_path(spark, "index")
    sizes = Observation()
    keys = corpus.select(F.col("ord").cast("bigint").alias("ord"), "doc_id", "text")
    counted = counted_terms(keys, ["ord", "doc_id"], "text", analyzer)
    counted = counted.observe(sizes, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.sum(F.size("terms")).alias("postings"))
    documents = _stored(counted, f"{folder}/documents")
    n_docs, total, n_postings = (sizes.get[c] or 0 for c in ("n", "total", "postings"))
    if documents.groupBy("doc_id").count().where("count > 1").head(1):
        raise ValueError("a doc_id is repeated")
    rows = documents.select("ord", "dl", F.explode("terms").alias("t")).select("t.term", "ord", "t.tf", "dl")
    vocabulary = Observation()
    terms = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).observe(vocabulary, F.count(F.lit(1)).alias("n"))
    terms = _stored(terms.withColumn("key", F.monotonically_increasing_id()), f"{folder}/terms")
    divisions = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_postings / DIVISION_POSTINGS)), MOST_DIVISIONS)
    buckets = min(max(LEAST_BUCKETS, math.ceil(n_postings / BUCKET_POSTINGS)), MOST_BUCKETS)
    rows = with_frequencies(rows, terms.select("term", "df"), vocabulary.get["n"] or 0).withColumn("bucket", term_bucket(F.col("term"), buckets))
    table = _divided(rows, f"{folder}/postings", divisions)
    docs = _stored(document_norms(documents.select("ord", "doc_id", "dl"), spark.table(table), n_docs), f"{folder}/docs")
    lists = documents.select("ord", "dl", F.slice("terms", 1, forward_terms).alias("terms"))
    return Index(docs, terms, spark.table(table), lists, analyzer, forward_terms, n_docs, total, divisions, buckets, (table,), folder)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
