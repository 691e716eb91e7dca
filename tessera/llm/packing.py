"""Filling containers of fixed capacity with texts by vector best-fit.

An item uses three resources of a container: tokens, a place among at most so
many documents, and attention cost (the square of its length).  An item whose
own cost is above the limit has a container to itself.  Items are taken
in descending length.  Each goes to the open container that satisfies every
constraint and is left with the smallest weighted residual norm, or has the
greatest weighted dot product of residual and demand; a new container is opened
only if none fits.

Items are dealt to shards of like size by a hash of the id, and each shard is
packed on its own.  A shard wastes part of one container at most beyond what
best-fit wastes, so with thousands of items a shard the whole is as tight as
one list would be, and no task sees more than a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import TOKENIZERS, VOCABULARY, encode_texts
from tessera.scratch import written

CAPACITY = 2048
#: Most documents of a container, and most attention cost of texts that share one, as a part of a full-length text's.
#: Below 1 the cost binds: a long text leaves less room for others than its tokens do.
DOCUMENTS, ATTENTION = 48, 0.8
#: Weights of the residual shares of tokens, documents and attention.
WEIGHTS = (1.0, 0.05, 0.05)
#: Items that a shard should have.
SHARD_ITEMS = 20_000


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float = ATTENTION, weights: tuple[float, float, float] = WEIGHTS, by: str = "norm") -> np.ndarray:
    """Container of each item, for lengths in descending order, none above the capacity.

    An item that alone costs more attention than allowed takes a whole container.
    ``by``: ``norm`` takes the smallest weighted residual norm after placing,
    ``dot`` the greatest weighted dot product of residual and demand.
    """
    weight = np.array(weights)
    place = np.zeros(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    free = np.zeros((1024, 3))  # shares of the capacity left, one row per open container
    name = np.zeros(1024, np.int64)
    opened = count = 0
    for i, length in enumerate(lengths):
        need = np.array([length / capacity, 1 / documents, min(1.0, length * length / (attention * capacity * capacity))])
        rest = free[:count] - need
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            score = (weight * rest[fits] ** 2).sum(axis=1) if by == "norm" else -(weight * free[fits] * need).sum(axis=1)
            at = fits[score.argmin()]
        else:
            if count == len(free):
                free, name = np.concatenate([free, np.zeros_like(free)]), np.concatenate([name, np.zeros_like(name)])
            at, free[count], name[count] = count, 1.0, opened
            opened, count = opened + 1, count + 1
        free[at] -= need
        place[i] = name[at]
        # A container that not even the shortest item fits is closed; the last open one takes its row.
        if free[at, 0] * capacity < least - 1e-9 or free[at, 1] < 0.5 / documents or free[at, 2] * attention * capacity * capacity < least * least - 1e-6:
            count -= 1
            free[at], name[at] = free[count], name[count]
    return place


def pack_lengths(
    items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, by: str = "norm",
    documents: int = DOCUMENTS, attention: float = ATTENTION, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """``(doc_id, part, first_token, n_tokens, container)`` from ``(doc_id, n_tokens)``.

    An item is one part unless it alone exceeds the capacity; then its parts
    but the last fill a container each.  Items of no token (null and empty
    texts) use no container and are given with part 0 and a null container.
    """
    kind = items.schema["doc_id"].dataType.simpleString()
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))
    cut = items.select("doc_id", "n_tokens", F.explode(parts).alias("part"))
    cut = cut.select("doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"))
    none = cut.where("n_tokens <= 0").withColumn("container", F.lit(None).cast("string"))
    some = cut.where("n_tokens > 0")
    shards = max(1, math.ceil(some.count() / shard_items))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        at = best_fit(pdf["n_tokens"].to_numpy(), capacity, documents, attention, weights, by)
        pdf["container"] = pdf["shard"].astype(str) + "-" + pd.Series(at, index=pdf.index).astype(str)
        return pdf[["doc_id", "part", "first_token", "n_tokens", "container"]]

    dealt = some.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int"))
    full = f"doc_id {kind}, part int, first_token int, n_tokens int, container string"
    return dealt.groupBy("shard").applyInPandas(pack, full).unionByName(none)


def pack_texts(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, by: str = "norm", **limits) -> DataFrame:
    """``pack_lengths``, with its ``limits``, of the texts' sizes in tokens of a public tokenizer.

    Repeated ids are packed as the rows they are.  An empty table gives an empty one.
    """
    sizes = encode_texts(df, id_col, text_col, tokenizers, vocabulary, counts_only=True)
    return pack_lengths(written(sizes.withColumnRenamed(id_col, "doc_id"), "sizes"), capacity, by=by, **limits)


def container_use(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(container, n_parts, n_tokens, unused, attention)``: what each container of ``pack_lengths`` holds.

    ``attention`` is the sum of squares of its parts' lengths as a part of the capacity's square.
    """
    square = F.pow(F.col("n_tokens") / capacity, F.lit(2.0))
    used = packed.where("container is not null").groupBy("container").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens"), F.sum(square).alias("attention"))
    return used.select("container", "n_parts", "n_tokens", (capacity - F.col("n_tokens")).alias("unused"), "attention")
