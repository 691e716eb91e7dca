"""Top N items of every group by statistics-guided skipping.

The rows are clustered by group into Parquet files with small row groups.  One
task per file then reads only the footer first, takes the row groups in
descending maximum score and leaves out every row group whose maximum lies
strictly below the N-th score already held by each group inside it.  A group
larger than a file spans several files, each of which yields N items at most;
a last, small ranking joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import new_path

#: Bytes of a row group (a few thousand rows), the unit of skipping: small against a large group's rows.
ROW_GROUP_BYTES = 1 << 15
#: Row groups read at a time where none can be left out.
ROW_GROUPS = 64


def cluster_by_group(df: DataFrame, groups: list[str], item: str, score: str, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``df`` to ``path`` clustered by group and, within it, by descending score.

    The range includes score and item, so a group of any size is cut into
    files of like size instead of landing in one task.
    """
    order = [*(F.col(c).asc() for c in groups), F.col(score).desc(), F.col(item).asc()]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.size", row_group_bytes)
        .option("compression", "zstd")
        .parquet(path)
    )


def best_rows(table: pa.Table, groups: list[str], n: int) -> pa.Table:
    """Best ``n`` distinct items per group, in order of group and place."""
    table = table.sort_by([*((c, "ascending") for c in groups), ("score", "descending"), ("item", "ascending")]).combine_chunks()
    starts = np.zeros(len(table), bool)
    starts[:1] = True
    for c in groups:
        codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    group = np.cumsum(starts) - 1
    items = table["item"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = group * (int(items.max(initial=0)) + 1) + items
    kept = np.sort(np.unique(key, return_index=True)[1])
    new = np.ones(len(kept), bool)
    new[1:] = group[kept][1:] != group[kept][:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(kept)), 0))
    return table.take(pa.array(kept[np.arange(len(kept)) - begin < n]))


def scan_file(path: str, groups: list[str], n: int) -> tuple[pa.Table | None, int, int]:
    """Best ``n`` items per group within one clustered file (some more of a group that fills row groups); row groups read and skipped.

    A row group is left out if each group in it has ``n`` items strictly above
    its maximum.  As a file is sorted by group and then by descending score, a
    row group of several groups holds the best rows of all of them but the
    first, so none of these can be left out: they come first, in descending
    maximum and many at a time.  Then come those of a single group, in
    descending maximum, each tested against what is held of its group.  What is
    done is linear in the rows read.
    """
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        names = file.schema_arrow.names
        several, single = [], []
        for i in range(file.num_row_groups):
            of = {c: file.metadata.row_group(i).column(names.index(c)).statistics for c in [*groups, "score"]}
            low, high = (tuple(getattr(of[c], end) if of[c] and of[c].has_min_max else None for c in groups) for end in ("min", "max"))
            top = of["score"].max if of["score"] and of["score"].has_min_max else np.inf
            (single if low == high and None not in low else several).append((-top, i, low))
        columns = [*groups, "item", "score"]
        order = [i for _, i, _ in sorted(several)]
        chunks = [order[j : j + ROW_GROUPS] for j in range(0, len(order), ROW_GROUPS)]
        parts = [best_rows(file.read_row_groups(chunk, columns=columns), groups, n) for chunk in chunks]
        found = best_rows(pa.concat_tables(parts), groups, n) if parts else None
        held: dict[tuple, pa.Table] = {}
        read = len(several)
        for negative, i, key in sorted(single):
            if key not in held:
                held[key] = found.filter(_of_group(found, groups, key)) if found else None
            own = held[key]
            if own is not None and len(own) == n and -negative < own["score"][n - 1].as_py():
                continue
            more = file.read_row_group(i, columns=columns)
            held[key] = best_rows(more if own is None else pa.concat_tables([own, more]), groups, n)
            read += 1
        tables = [t for t in (found, *held.values()) if t is not None]
        return (pa.concat_tables(tables) if tables else None), read, file.num_row_groups - read


def _of_group(table: pa.Table, groups: list[str], key: tuple) -> pa.ChunkedArray:
    """Which rows are of one group."""
    of = None
    for c, value in zip(groups, key, strict=True):
        same = pc.equal(table[c], pa.scalar(value, table.schema.field(c).type))
        of = same if of is None else pc.and_(of, same)
    return of


def top_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int = 10, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """The ``n`` highest-scoring distinct items of every group: group columns, item, score, ``rank``.

    Rows with a null group column, item or score, or a NaN score, are left out.
    An item counts once per group, with its highest score.  Ties in score go to
    the smaller item by bytes.  Groups of fewer than ``n`` items give all; an
    empty table gives an empty one.  Other columns are ignored, whatever their
    names.
    """
    spark = df.sparkSession
    keys = [f"g{i}" for i in range(len(groups))]
    kinds = [df.schema[c].dataType for c in [*groups, item]]
    clean = df.select(*(F.col(c).alias(k) for c, k in zip(groups, keys, strict=True)), F.col(item).alias("item"), (F.col(score).cast("double") + 0.0).alias("score"))
    clean = clean.dropna().where(~F.isnan("score"))
    path = new_path(spark, "clustered")
    cluster_by_group(clean, keys, "item", "score", path, row_group_bytes)
    files = sorted(spark.read.schema(clean.schema).parquet(path).inputFiles())
    fields = [*(T.StructField(k, t) for k, t in zip([*keys, "item"], kinds, strict=True)), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)

    shipped = spark.sparkContext.broadcast(files)  # a name per written file, of which there are as many as tasks

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held, _, _ = scan_file(shipped.value[i], keys, n)
                if held is not None:
                    yield from held.select([f.name for f in fields]).to_batches()

    if not files:
        best = spark.createDataFrame([], schema)
    else:
        best = spark.range(0, len(files), 1, len(files)).mapInArrow(scan, schema)
    best = best.groupBy(*keys, "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("item"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.select(*(F.col(k).alias(c) for c, k in zip(groups, keys, strict=True)), F.col("item").alias(item), F.col("score").alias(score), "rank")
