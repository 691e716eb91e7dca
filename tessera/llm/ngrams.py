"""Occurrence and record counts of every term or n-gram, from suffix arrays.

Each task takes whole records in blocks of bounded size and sorts the suffixes
of a block by prefix doubling, to the end of their records.  The common prefixes
of neighbours hold the counts of n-grams of every length; what is asked for, up
to a length, is read off the same structure.  A run of neighbouring suffixes whose common
prefix has at least n terms is the interval of one n-gram: its length is the
number of occurrences.  Its number of records is that length less the suffixes
whose predecessor from the same record lies in the same interval, i.e. less the
duplicate adjacencies within a record.  As a record lies in one block, counts of
blocks add up, so a block is also the combine step before the only shuffle of
counts and no term, however common, gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.records import TERM_RE, one_per_record

#: Terms in a block; bounds the memory of a task (about 200 bytes a term) and nothing else.
BLOCK_TERMS = 1 << 20


def suffix_ranks(code: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... terms, until no more terms tell any two of them apart.

    ``code``: symbols from 1; ``rest``: terms from here to the end of the record.
    """
    ranks, k = [code.astype(np.int32)], 1
    distinct = len(np.unique(code))
    while k < rest.max(initial=0):
        ahead = np.zeros(len(code), np.int64)
        ahead[:-k or None] = ranks[-1][k:]
        ahead[rest <= k] = 0
        key = ranks[-1].astype(np.int64) * (int(ranks[-1].max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        moved = np.ones(len(key), np.int64)
        moved[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(code), np.int32)
        rank[order] = np.cumsum(moved)
        ranks.append(rank)
        if int(rank.max()) == distinct:
            break
        distinct, k = int(rank.max()), 2 * k
    return ranks


def suffix_order(ranks: list[np.ndarray]) -> np.ndarray:
    """Suffixes in order of all their terms, ties by position."""
    return np.argsort(ranks[-1], kind="stable")


def common_prefixes(ranks: list[np.ndarray], rest: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it, from the lengths 2^i at which ranks agree.

    Suffixes of equal last rank are equal to their ends; of all others the
    common length is below the last length, so each length counts once at most.
    """
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    left_a, left_b = rest[a], rest[b]
    same = ranks[-1][a] == ranks[-1][b]
    shared[1:][same] = left_a[same]
    left_a[same] = 0
    for i in range(len(ranks) - 2, -1, -1):
        live = np.flatnonzero((left_a >= 1 << i) & (left_b >= 1 << i))
        live = live[ranks[i][a[live]] == ranks[i][b[live]]]
        shared[live + 1] += 1 << i
        for at, left in ((a, left_a), (b, left_b)):
            left[live] -= 1 << i
            at[live] = np.where(left[live] > 0, at[live] + (1 << i), at[live])
    return shared


def block_counts(texts: list[str], max_n: int) -> pa.RecordBatch:
    """n, n-gram, occurrences and records of every n-gram of one block of records."""
    each = [TERM_RE.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    words = [w for ws in each for w in ws]
    out: list[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]] = []
    if words:
        code, names = pd.factorize(np.array(words, dtype=object))
        record = np.repeat(np.arange(len(each)), sizes)
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
        ranks = suffix_ranks(code + 1, rest)
        order = suffix_order(ranks)
        shared = common_prefixes(ranks, rest, order)
        of = record[order]
        by_record = np.argsort(of, kind="stable")
        before = np.full(len(order), -1)
        same = of[by_record][1:] == of[by_record][:-1]
        before[by_record[1:][same]] = by_record[:-1][same]
        for n in range(1, max_n + 1):
            interval = np.cumsum(shared < n) - 1
            held = rest[order] >= n
            again = held & (before >= 0)
            again[again] = interval[before[again]] == interval[again]
            size = int(interval[-1]) + 1
            occurrences = np.bincount(interval[held], minlength=size)
            repeats = np.bincount(interval[again], minlength=size)
            first = order[np.flatnonzero(shared < n)]
            some = occurrences > 0
            first = first[some]
            if n == 1:
                grams = list(names[code[first]])
            else:
                grams = [" ".join(words[i : i + n]) for i in first]
            out.append((np.full(len(grams), n), grams, occurrences[some], occurrences[some] - repeats[some]))
    names = ["n", "ngram", "n_occurrences", "n_records"]
    if not out:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64())], names=names)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([o[0] for o in out]), pa.int32()),
            pa.array([g for o in out for g in o[1]], pa.string()),
            pa.array(np.concatenate([o[2] for o in out]), pa.int64()),
            pa.array(np.concatenate([o[3] for o in out]), pa.int64()),
        ],
        names=names,
    )


def ngram_counts(df: DataFrame, id_col: str, text_col: str, max_n: int = 1, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(n, ngram, n_occurrences, n_records)`` of every n-gram of 1 to ``max_n`` terms.

    A record is one id, counted once however many rows it has; rows with a null
    id or text are left out; empty and blank texts, and an empty table, hold no
    n-gram.  n-grams do not run across records.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(text)
                held += len(text) // 6 + 1
                if held >= block_terms:
                    yield block_counts(texts, max_n)
                    texts, held = [], 0
        if texts:
            yield block_counts(texts, max_n)

    blocks = one_per_record(df, id_col, text_col).select("text").mapInArrow(count, "n int, ngram string, n_occurrences bigint, n_records bigint")
    return blocks.groupBy("n", "ngram").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def marked_counts(df: DataFrame, id_col: str, text_col: str, max_n: int = 1, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """``ngram_counts`` with ``mark``: ``rare``, ``common`` or null.

    ``rare``: fewer than ``rare_below`` records; ``common``: more than the share
    ``common_above`` of the records with a text, empty and blank ones included.
    Where both hold, as in tiny collections, the mark is ``rare``.
    """
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().count()
    records = F.col("n_records")
    mark = F.when(records < rare_below, "rare").when(records > common_above * texts, "common")
    return ngram_counts(df, id_col, text_col, max_n).withColumn("mark", mark)
