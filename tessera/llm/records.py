"""Shared pieces of the text operators: terms and one-row-per-record views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a maximal run of these characters in the lower-cased text.
TERM = "[a-z0-9]+"
TERM_RE = re.compile(TERM)


def terms_of(text: str) -> list[str]:
    """Terms of one text, in order."""
    return TERM_RE.findall(text.lower())


def terms_column(text: Column) -> Column:
    """Terms of a text column as an array, inside the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def one_per_record(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, text)``: each record with a text once.

    Rows whose id or text is null are left out.  A record in several rows keeps
    the smallest text by bytes, so the choice never depends on row order; the
    aggregate combines before the shuffle, so a record repeated in a third of
    all rows sends one row per task.  An empty table gives an empty table.
    """
    return (
        df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"))
        .where(F.col("rec_id").isNotNull() & F.col("text").isNotNull())
        .groupBy("rec_id")
        .agg(F.min("text").alias("text"))
    )
