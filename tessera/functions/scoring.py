"""The best documents of many queries among the postings of a task, which holds its documents whole.

Python workers import this and no more, so it needs neither Spark nor pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs

#: Queries that a worker reads at a time, documents of which one maximum is taken, and matches in a batch.
QUERIES_AT_ONCE, STRIDE, MATCHES_AT_ONCE = 4096, 64, 1_000_000
#: Scores are ranked by this many parts of 1.
PARTS = 1e6

#: From the columns of a task's postings to each posting's part of a score.
Part = Callable[..., np.ndarray]


class Postings:
    """Postings by term, documents numbered from 0 in their order."""

    def __init__(self, term: np.ndarray, ord: np.ndarray, values: list[np.ndarray]) -> None:
        by_term = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[by_term], return_index=True)
        self.ends = np.append(first, len(term))
        self.ords, place = np.unique(ord, return_inverse=True)
        self.place = place.reshape(-1)[by_term]
        self.values = [v[by_term] for v in values]

    def found(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term here, -1 without one."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def _best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best positive sums, ties to the first place."""
    # k groups have a sum of at least the k-th largest of their maxima, so the k-th best sum is no less.
    tops = sums.reshape(STRIDE, -1).max(axis=0)
    least = np.partition(tops, -k)[-k] if len(tops) > k else 0.0
    found = np.flatnonzero(sums >= least - 2 / PARTS) if least > 2 / PARTS else np.flatnonzero(sums > 0)
    scores = sums[found]
    order = np.argsort(-np.floor(scores * PARTS + 0.5), kind="stable")[:k]
    return found[order], scores[order]


def _asked(path: str, slices: int, slice_: int, sides: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Queries of a slice of a folder of Parquet files: their numbers, whether they are mixed, where the terms of each end, all terms and weights of each side."""
    names = [f"weights_{i}" for i in range(sides)]
    system, at = fs.FileSystem.from_uri(path)
    kept = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.size and f.base_name.endswith(".parquet")]
    for file in sorted(kept):
        table = ds.dataset(file, format="parquet", filesystem=system)
        for batch in table.to_batches(columns=["q", "some", "terms", *names], batch_size=QUERIES_AT_ONCE, use_threads=False):
            if slices > 1:
                batch = batch.filter(pa.array(batch.column("q").to_numpy() % slices == slice_))
            if batch.num_rows:
                sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                some = batch.column("some").to_numpy(zero_copy_only=False)
                yield batch.column("q").to_numpy(), some, np.append(0, np.cumsum(sizes)), batch.column("terms").flatten().to_numpy(), *(batch.column(c).flatten().to_numpy() for c in names)


def gathered(batches: Iterator[pa.RecordBatch]) -> Postings | None:
    """Postings of batches of term, ord and further columns; nothing without a row."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return None
    term, ord, *values = (np.concatenate(c) for c in zip(*held, strict=True))
    return Postings(term, ord, values)


def _added(sums: np.ndarray, postings: Postings, part: np.ndarray, terms: list[int], weights: list[float]) -> None:
    for t, w in zip(terms, weights, strict=True):
        if t >= 0 and w:
            rows = slice(postings.ends[t], postings.ends[t + 1])
            sums[postings.place[rows]] += w * part[rows]


def best_documents(batches: Iterator[pa.RecordBatch], path: str, parts: list[Part], k: int, slices: int = 1, slice_: int = 0, mixes: list[float] | None = None) -> Iterator[pa.RecordBatch]:
    """``(q, p, ord, score)``: the ``k`` best documents of a task for every query of a folder and every part, or every mix of two sides."""
    postings = gathered(batches)
    if postings is None or k <= 0:
        return
    sums = np.zeros((1 if mixes is None else 2, -(-len(postings.ords) // STRIDE) * STRIDE))
    mixed = np.zeros(sums.shape[1])
    for p, make in enumerate(parts):
        part = make(*postings.values)
        for numbers, some, bounds, terms, *weights in _asked(path, slices, slice_, len(sums)):
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            at = postings.found(terms).tolist()
            sides, bounds = [w.tolist() for w in weights], bounds.tolist()
            for i, q in enumerate(numbers):
                own = slice(bounds[i], bounds[i + 1])
                if max(at[own], default=-1) < 0:
                    continue
                for side, w in zip(sums, sides, strict=True):
                    _added(side, postings, part, at[own], w[own])
                if mixes is None:
                    out.append((q, p, *_best(sums[0], k)))
                elif not some[i]:
                    found = _best(sums[0], k)
                    out += [(q, m, *found) for m in range(len(mixes))]
                else:
                    difference = sums[0] - sums[1]
                    for m, share in enumerate(mixes):
                        np.multiply(difference, share, out=mixed)
                        mixed += sums[1]
                        out.append((q, m, *_best(mixed, k)))
                sums.fill(0)
            if out:
                sizes = [len(x[2]) for x in out]
                q, which = (np.repeat(np.array([x[c] for x in out], kind), sizes) for c, kind in ((0, np.int64), (1, np.int32)))
                found, scores = (np.concatenate([x[c] for x in out]) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(which), pa.array(postings.ords[found]), pa.array(scores)], names=["q", "p", "ord", "score"])


def matches(batches: Iterator[pa.RecordBatch], path: str, every: bool, slices: int = 1, slice_: int = 0) -> Iterator[pa.RecordBatch]:
    """``(q, ord)``: the documents of a task that hold a term, or ``every`` term, of each query of a folder."""
    postings = gathered(batches)
    if postings is None:
        return
    held = np.zeros(len(postings.ords), np.int32)
    out: list[tuple[int, np.ndarray]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        q = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out])
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(postings.ords[np.concatenate([x[1] for x in out])])], names=["q", "ord"])

    for numbers, _, bounds, terms, _ in _asked(path, slices, slice_, 1):
        at = postings.found(terms)
        for i, q in enumerate(numbers):
            own = at[bounds[i] : bounds[i + 1]]
            if own.max(initial=-1) < 0 or every and own.min() < 0:
                continue
            for t in own[own >= 0]:
                held[postings.place[postings.ends[t] : postings.ends[t + 1]]] += 1
            out.append((q, np.flatnonzero(held == len(own) if every else held)))
            size += len(out[-1][1])
            held.fill(0)
            if size >= MATCHES_AT_ONCE:
                yield batch()
                out, size = [], 0
    if out:
        yield batch()
