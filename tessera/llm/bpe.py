"""Byte-level BPE ids of every text, merged with a segment tree over pair ranks.

A text is cut into pieces by the tokenizer's published pattern.  Within a piece
the leaves of a segment tree hold the ranks of adjacent pairs, its root the
leftmost pair of lowest rank.  Each merge updates three leaves in logarithmic
time, until no pair can be merged; a piece of n bytes takes O(n log n) however
long it is.  Short pieces repeat, so a worker keeps their ids.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to so many characters are kept, up to so many of them in a worker; then the store starts anew.
KEPT_LENGTH, KEPT_PIECES = 32, 400_000
#: Characters of texts encoded into one output batch.
BATCH_CHARS = 4 << 20


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by repeated leftmost lowest-rank merges."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    shift = n.bit_length()
    none = 1 << 62
    end = list(range(1, n + 1))  # where the symbol that starts here ends; -1: no symbol starts here
    start = list(range(-1, n - 1))  # where the symbol before the one that starts here starts
    # A node holds rank << shift | position, so the minimum is the leftmost of the lowest rank.
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    def pair(i: int) -> int:
        after = end[i]
        rank = ranks.get(piece[i : end[after]]) if after < n else None
        return none if rank is None else rank << shift | i

    mask = (1 << shift) - 1
    while (root := tree[1]) != none:
        i = root & mask
        gone = end[i]
        end[i] = end[gone]
        end[gone] = -1
        if end[i] < n:
            start[end[i]] = i
        if gone < n - 1:
            put(gone, none)
        put(i, pair(i))
        if start[i] >= 0:
            put(start[i], pair(start[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts with one vocabulary; keeps the ids of short pieces."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else merge_piece(data, self.ranks)
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        get, make = self.kept.get, self._piece
        return list(itertools.chain.from_iterable([get(p) or make(p) for p in self.find(text)]))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary file at ``path``."""
    with open(path, "rb") as file:
        return Encoder(file.read())


def _vocabulary(spark, tokenizers: str, vocabulary: str, ship: bool):
    """A function that gives the vocabulary file's path on whichever machine calls it."""
    path = f"{tokenizers}/{vocabulary}"
    if not ship:
        return lambda: path
    spark.sparkContext.addFile(path)
    return lambda: SparkFiles.get(vocabulary)


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, counts_only: bool = False, ship: bool = False) -> DataFrame:
    """``(id, ids)``: every row's text as token ids without special tokens.

    Null and empty texts have the empty list; blank texts have the ids of their
    white space.  Strings that look like special tokens are ordinary text.
    Rows map one to one, repeated ids and null ids included.  With
    ``counts_only`` the second column is ``n_tokens`` instead of ``ids``.  The
    vocabulary file must exist at the same path on every machine, or ``ship``
    sends the driver's copy to them.
    """
    kind = df.schema[id_col].dataType
    field = T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(id_col, kind), field])
    locate = _vocabulary(df.sparkSession, tokenizers, vocabulary, ship)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(locate())
        for batch in batches:
            texts, i = batch.column(1), 0
            while i < len(texts):
                ids: list[int] = []
                lengths: list[int] = []
                chars, begin = 0, i
                while i < len(texts) and chars < BATCH_CHARS:
                    text = texts[i].as_py()
                    chars += len(text or "")
                    before = len(ids)
                    ids += own.encode(text)
                    lengths.append(len(ids) - before)
                    i += 1
                if counts_only:
                    values: pa.Array = pa.array(lengths, pa.int32())
                else:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i - begin), values], names=[id_col, field.name])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(encode, schema)
