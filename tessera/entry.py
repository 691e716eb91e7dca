"""Build, load and ask an index by paths and strings, in the active session.

``retrieve`` answers one query and pays Spark's job latency; ``retrieve_all``
ranks a whole set of topics in one plan and is what evaluation uses.
"""

from __future__ import annotations

import inspect
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import ranking as rk
from tessera.operators.analysis import Analyzer
from tessera.operators.index import Index
from tessera.operators.index import build_index as build
from tessera.session import prepare
from tessera.sources import files

_loaded: Index | None = None
#: Fixed value: the functions of an entry point and how many arguments each is called with.
SIGNATURES = {"build_index": 2, "load_index": 1, "retrieve": 2}


def _session() -> SparkSession:
    return prepare(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())


def build_index(corpus_path: str, index_dir: str) -> None:
    """Index a JSON-lines collection and write everything that ``load_index`` needs."""
    index = build(files.read_corpus(_session(), corpus_path), Analyzer(title_boost=rk.ENTRY_TITLE_BOOST))
    index.save(index_dir)
    index.close()


def load_index(index_dir: str) -> None:
    """Make a saved index the one that is asked from now on."""
    global _loaded
    if _loaded is not None:
        _loaded.close()
    _loaded = Index.load(_session(), index_dir)


def retrieve_all(queries: DataFrame, k: int = 10) -> DataFrame:
    """``(qid, ord, doc_id, score, rank)`` of all topics ``(qid, text)``, filled to ``k``."""
    if _loaded is None:
        raise RuntimeError("no index is loaded")
    return rk.retrieve(queries, _loaded, k)


def retrieve(query: str, k: int) -> list[tuple[str, float]]:
    """The ``k`` best documents of one query with their scores, best first."""
    if _loaded is None:
        raise RuntimeError("no index is loaded")
    asked = _loaded.spark.createDataFrame([("q", query)], "qid string, text string")
    return [(r.doc_id, r.score) for r in retrieve_all(asked, k).orderBy("rank").collect()]


def conformance(module: ModuleType) -> list[str]:
    """What keeps a module from being an entry point: functions that it lacks or that can't be called as they will be."""
    faults = []
    for name, arguments in SIGNATURES.items():
        f = getattr(module, name, None)
        if not callable(f):
            faults.append(f"{name} is missing")
            continue
        try:
            inspect.signature(f).bind(*range(arguments))
        except TypeError:
            faults.append(f"{name} can't be called with {arguments} arguments")
    return faults
