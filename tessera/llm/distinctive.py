"""How characteristic a term is of its record: divergence from randomness.

The score is the information content of the term's frequency under a geometric
model of the collection, times the Laplace after-effect gain.  Frequencies are
normalised to the record's length first.  Terms that the collection holds
everywhere get little, terms that only a few records hold get much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.records import one_per_record, terms_column
from tessera.operators.index import with_frequencies
from tessera.scratch import written


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, term, tf, length)`` of every term of every record."""
    records = one_per_record(df, id_col, text_col).select("rec_id", terms_column(F.col("text")).alias("terms"))
    each = records.select("rec_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy("rec_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def dfr_score(tf: Column, length: Column, occurrences: Column, records: Column, mean_length: Column, spread: float = 1.0) -> Column:
    """Geometric information content x Laplace gain at length-normalised frequency.

    With F occurrences in N records and L = F / N, a normalised frequency f has
    the content log2(1 + L) + f log2((1 + L) / L) and the gain 1 / (f + 1),
    where f = tf log2(1 + spread * mean length / length).
    """
    mean = occurrences / records
    f = tf * F.log2(F.lit(1.0) + F.lit(spread) * mean_length / length)
    return (F.log2(1 + mean) + f * F.log2((1 + mean) / mean)) / (f + 1)


class TermModel:
    """Term statistics of a collection, made once and used for any number of record sets.

    ``counts`` has ``(rec_id, term, tf, length)`` of its own records, ``stats``
    ``(term, df, occurrences)``.  Records with a null id or text are left out, a
    record in several rows counts once, empty and blank texts hold no term but
    count as records.
    """

    def __init__(self, corpus: DataFrame, id_col: str, text_col: str):
        self.counts = written(term_frequencies(corpus, id_col, text_col), "term-counts")
        # One row per term and task after the map-side combine, so common terms don't gather.
        self.stats = written(self.counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")), "term-stats")
        self.terms = self.stats.count()
        texts = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col).distinct().count()
        total = self.stats.agg(F.sum("occurrences")).first()[0] or 0
        self.records, self.mean_length = max(texts, 1), total / max(texts, 1) or 1.0

    def _dfr(self, tf: Column, occurrences: Column) -> Column:
        return dfr_score(tf, F.col("length"), occurrences, F.lit(float(self.records)), F.lit(float(self.mean_length)))

    def _score(self, counts: DataFrame) -> DataFrame:
        score = self._dfr(F.col("tf"), F.col("occurrences"))
        # Terms that very many records hold are sent to every task, so none is a hot key.
        return with_frequencies(counts, self.stats, self.terms).select("rec_id", "term", "tf", "df", "length", score.alias("score"))

    def least_score(self, tf: int, fewest: int, most: int) -> Column:
        """What a term that ``fewest`` to ``most`` records hold scores at least in a record that has it ``tf`` times or more.

        A column over ``length``.  It is the score at exactly so many
        occurrences of the most frequent of these terms, as the score grows with
        the occurrences in the record and falls with those in the collection
        where the latter are fewer than records and the record isn't so long
        that its normalised frequency is below the collection's; else 0.
        """
        often = self.stats.where(F.col("df").between(fewest, most)).agg(F.max("occurrences")).first()[0] or 1
        rate, f = often / self.records, tf * F.log2(1 + F.lit(float(self.mean_length)) / F.col("length"))
        return F.when(F.lit(rate < 1) & (f > rate), self._dfr(F.lit(tf), F.lit(often))).otherwise(0.0)

    def own_scores(self) -> DataFrame:
        """``(rec_id, term, tf, df, length, score)`` of every term of every record of the collection."""
        return self._score(self.counts)

    def scores(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The same of other records; a term that the collection lacks has no statistics and gives no row."""
        return self._score(term_frequencies(df, id_col, text_col))


def distinctiveness(corpus: DataFrame, id_col: str, text_col: str, subject: DataFrame | None = None, subject_id: str | None = None, subject_text: str | None = None) -> DataFrame:
    """``(rec_id, term, tf, df, length, score)`` of the records of ``subject``, by default of ``corpus``, as ``TermModel`` gives it.

    Empty tables give no rows.
    """
    model = TermModel(corpus, id_col, text_col)
    return model.own_scores() if subject is None else model.scores(subject, subject_id, subject_text)
