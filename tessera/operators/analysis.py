"""From texts to counted index terms, one row per text and without a shuffle.

Tokens are found in the JVM.  Stems come from Arrow batches: a batch's tokens
are dictionary-encoded, so Python stems each distinct word of a batch once, and
the counts of a text are made in the same pass.  No vocabulary is collected or
joined, so a token that every text holds is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.counting import terms_counted, terms_in_order
from tessera.functions.text import STOPWORDS, boost_title, tokenize


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms; the same for documents and queries, but for the title's weight."""

    remove_stopwords: bool = True
    stemming: bool = True
    title_boost: int = 1

    def tokens(self, text: Column, of_document: bool = True) -> Column:
        """Array of the tokens that count, in order."""
        text = F.coalesce(text, F.lit(""))
        found = tokenize(boost_title(text, self.title_boost) if of_document else text)
        return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if self.remove_stopwords else found


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the session has cores, spread over the cores; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _mapped(df: DataFrame, keys: list[str], tokens: Column, make: Callable, stemming: bool, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keys), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(batch, stemming)], names=schema.names)

    return df.select(*keys, tokens.alias("tokens")).mapInArrow(run, schema)


def analyze(df: DataFrame, id_col: str, text_col: str, analyzer: Analyzer = Analyzer(), of_document: bool = True) -> DataFrame:
    """``(id, pos, term)`` of every occurrence, in order of ``pos`` from 0."""
    fields = [T.StructField("terms", T.ArrayType(T.StringType()))]
    listed = _mapped(df, [id_col], analyzer.tokens(F.col(text_col), of_document), terms_in_order, analyzer.stemming, fields)
    return listed.select(id_col, F.posexplode("terms").alias("pos", "term"))


def counted_terms(df: DataFrame, keys: list[str], text_col: str, analyzer: Analyzer, of_document: bool = True) -> DataFrame:
    """``keys``, ``dl`` and ``terms``: length of each text and its terms with their counts.

    One row per text; terms come by descending count, ties to the one that
    occurs first.  A text is never moved, and neither are its terms.
    """
    held = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    fields = [T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(held))]
    return _mapped(df, keys, analyzer.tokens(F.col(text_col), of_document), terms_counted, analyzer.stemming, fields)


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """``(qid, term, qtf)`` from ``(qid, text)``; queries without a term have no row, rows of one qid add up."""
    each = counted_terms(queries, ["qid"], "text", analyzer, of_document=False).select("qid", F.explode("terms").alias("t"))
    return each.groupBy("qid", F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("qtf"))
