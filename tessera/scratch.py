"""Shared working storage: intermediate tables and lineage cuts.

Every intermediate goes to the folder that the session names in
``spark.checkpoint.dir``, which all executors of a cluster can reach, so a lost
executor never takes an intermediate with it.  Where the setting is absent, a
local session, as in tests, gets a temporary folder; on a cluster its absence
is an error, as a machine's own disk would lose what others need.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediates, as a URI or path that every executor can reach."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder, removed when the driver exits or its scope ends."""
    path = f"{scratch_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, with its lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What the shuffles of the jobs within left on disk goes when each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_once(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``written``, with the shuffles of its job freed."""
    with shuffles_freed(df.sparkSession):
        return written(df, name, **options)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        forget(table.sparkSession, table.scratch_path)


def release(since: int = 0) -> None:
    """Delete what this process wrote to the scratch folder, all of it or what came after a mark."""
    while len(_written) > since:
        delete(*_written.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whichever file system it is; nothing happens if it is gone."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete the intermediates at or below ``folder`` now."""
    for entry in [e for e in _written if e[1].startswith(folder)]:
        _written.remove(entry)
        delete(*entry)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Frees the intermediates made within; results must be written or collected before it ends."""
    mark = len(_written)
    try:
        yield
    finally:
        release(mark)


atexit.register(release)
