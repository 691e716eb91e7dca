"""Topics that arrive as a stream, ranked against a static index.

Each micro-batch of topics is one set-at-a-time ranking, so the batch plan is
the plan of a query batch and the stream keeps no state of its own.  Output is
written per batch under the batch's number: a batch that runs again after a
failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import Index
from tessera.operators.ranking import bm25


def rank_stream(topics: DataFrame, index: Index, path: str, checkpoint: str, k: int = 10, ranker: Callable[[DataFrame, Index, int], DataFrame] = bm25, **trigger) -> StreamingQuery:
    """Start ranking a streaming ``(qid, text)``; results are Parquet below ``path``, one folder per batch."""

    def each(batch: DataFrame, number: int) -> None:
        ranker(batch, index, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return topics.select("qid", "text").writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()
