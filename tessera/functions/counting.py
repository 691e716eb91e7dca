"""Terms and counts of Arrow batches of token lists.

Python workers import this and no more, so it needs neither Spark nor pandas.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.porter import stem

#: Stems that a worker keeps; then its store starts anew.
KEPT_STEMS = 1_000_000
_stems: dict[str, str] = {}


def _codes(tokens: pa.Array, stemming: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number per token, equal for equal terms, and the terms by number."""
    encoded = tokens.dictionary_encode()
    words = encoded.dictionary.to_pylist()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    if stemming:
        if len(_stems) > KEPT_STEMS:
            _stems.clear()
        words = [_stems.get(w) or _stems.setdefault(w, stem(w)) for w in words]
    terms, of_word = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (np.zeros(0, object), np.zeros(0, np.int64))
    return of_word.reshape(-1)[code], terms


def _lists(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch whose last column is the lists of tokens, and how many each row has."""
    lists = batch.column(batch.num_columns - 1)
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def terms_in_order(batch: pa.RecordBatch, stemming: bool) -> list[pa.Array]:
    tokens, sizes = _lists(batch)
    code, terms = _codes(tokens, stemming)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(terms, pa.string()).take(pa.array(code)))]


def terms_counted(batch: pa.RecordBatch, stemming: bool) -> list[pa.Array]:
    tokens, sizes = _lists(batch)
    code, terms = _codes(tokens, stemming)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, first, tf = np.unique(row * max(len(terms), 1) + code, return_index=True, return_counts=True)
    of = row[first]
    order = np.lexsort((first, -tf, of))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]), pa.int32())
    held = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(code[first][order])), pa.array(tf[order], pa.int64())], names=["term", "tf"])
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, held)]
