"""Near-duplicate records by an LSH forest.

Every record gets a min-hash signature of its word shingles.  Each tree of the
forest is one order of the records by a different sequence of signature values;
records that share most of their shingles tend to share a long prefix there.
Candidates are neighbours within a region of common prefix.  Two common values
are enough for that, and every record brings a sketch (four bits of every
signature value) to its regions: all records of a region are compared there, and
only the few pairs whose sketches differ as little as those of similar records
leave it, so the room of the candidates does not grow with that of the regions.
A region of more than ``ROOM`` records, or one where more than ``LOOKALIKES``
pairs a record would leave, is a crowded one.

What a crowded region leaves out is not lost.  Its records take part in an exact
join as well, by the rarest of their shingles: two records of the wanted
similarity must share one of so many that a short prefix of each record's
shingles, those that many records hold coming last, finds them.  Boilerplate
that crowds a region therefore joins nothing by itself.

All candidates are verified on the shingle sets.  Records of equal term
sequences form a class first and only one of its members enters the forest.

The trees are made and the exact join is done in parts, one after the other, and
what a part has moved or written is deleted when its candidates are known: the
disk that the whole takes at once is that of the largest step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.records import one_per_record, terms_column
from tessera.scratch import dropped, written, written_once

#: Signature values of a record; trees; values that a tree starts with and shares with no other; it sorts by one more.
VALUES, TREES, OWN = 128, 32, 3
#: Trees that are moved and sorted at once, more of them if they have no more than so many rows.
AT_ONCE, ROWS_AT_ONCE = 4, 400_000
#: Bits of every value in the sketch, and its columns: 64 values each, first all those of the lowest bit.
BITS = 4
SKETCH = [f"s{i}" for i in range(2 * BITS)]
_SKETCH_DDL = ", ".join(f"{c} bigint" for c in SKETCH)
#: Records of a region that are all compared with each other, and neighbours compared in a larger one.
ROOM, WINDOW = 1 << 17, 8
#: Pairs a record that may leave a region; regions of up to so many records are compared many at once, larger ones in blocks of so many pairs.
LOOKALIKES, SMALL, BLOCK = 16, 32, 1 << 15
#: Classes of up to so many equal records are written out as all their pairs, larger ones as links to the smallest id.
EXPAND = 64
#: A shingle that more crowded records hold is a common one; there are at most so many of them (8 bytes each go to every task).
COMMON_FROM, COMMON_MOST = 1000, 200_000
SALT = 16
#: Parts of the exact join, each of so many shingles at least; verified at once are a candidate for so many classes, but in so many parts at most.
PARTS, SHINGLES_A_PART = 8, 2_000_000
CLASSES_A_CANDIDATE, VERIFIED_PARTS = 8, 32
#: What a row of the pass over the forest tells: a candidate, a crowded record, a record or a crowded part of a cut region.
CANDIDATE, CROWDED, CUT, CUT_CROWDED = range(4)
_SEEDS = np.random.default_rng(20240301).integers(1, 1 << 63, (2, VALUES), dtype=np.uint64) | np.uint64(1)


def shingles(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` terms of an array of at least so many."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + d) for d in range(size)))))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Low 16 bits of the min-hash values (records x values) of records whose shingles begin at ``starts``."""
    out = np.zeros((len(starts), VALUES), np.uint16)
    for i in range(VALUES):
        mixed = ((hashes * _SEEDS[0, i] + _SEEDS[1, i]) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(mixed, starts)
    return out


def _shingle_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records' numbers, all their shingles and where each record's begin, of a batch ``(num, shingles)``."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return batch.column(0).to_numpy(), hashes, np.cumsum(sizes) - sizes


def sketches(v: np.ndarray) -> np.ndarray:
    """The sketch's columns (columns x records) of signatures (records x values)."""
    planes = [np.packbits(((v >> bit) & 1).astype(np.uint8), axis=1).view(np.int64) for bit in range(BITS)]
    return np.concatenate([p.T for p in planes])


def signature_rows(batch: pa.RecordBatch, trees: int) -> pa.RecordBatch:
    """Number and sketch of every record, and its sort keys: a tree and the leading values there."""
    num, hashes, starts = _shingle_lists(batch)
    values = signatures(hashes, starts)
    v, keys = values.astype(np.uint64), []
    for tree in range(trees):
        a, b, c, d = (v[:, (OWN * tree + i) % VALUES] for i in range(4))
        keys.append((np.uint64(tree) << np.uint64(56)) | a << np.uint64(40) | b << np.uint64(24) | c << np.uint64(8) | d >> np.uint64(8))
    columns = [pa.array(c) for c in (num, *sketches(values), *(k.astype(np.int64) for k in keys))]
    return pa.RecordBatch.from_arrays(columns, names=["num", *SKETCH, *_keys(range(trees))])


def _keys(trees: range) -> list[str]:
    return [f"k{tree}" for tree in trees]


def signed_rows(lists: DataFrame, trees: int) -> DataFrame:
    """``(num, s0, ..., k0, ...)`` of ``(num, shingles)`` rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                yield signature_rows(batch.slice(i, 1000), trees)

    return lists.mapInArrow(rows, ", ".join(f"{c} bigint" for c in ["num", *SKETCH, *_keys(range(trees))]))


def least_agreement(threshold: float, bits: int = 2, deviations: float = 4.5) -> int:
    """Values of whose last bits two records of the threshold's similarity share at least so many, but for four cases in a million."""
    p = threshold + (1 - threshold) / 2**bits
    return math.floor(VALUES * p - deviations * math.sqrt(VALUES * p * (1 - p)))


class Sketched:
    """Which records' sketches differ as little as those of records of the threshold's similarity, but for four cases in a million."""

    def __init__(self, threshold: float):
        self.most = [VALUES - least_agreement(threshold, 2, 5), VALUES - least_agreement(threshold, BITS, 4.6)]

    @staticmethod
    def _apart(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        low, high = x[0] ^ y[0], x[1] ^ y[1]
        for i in range(2, len(x), 2):
            low |= x[i] ^ y[i]
            high |= x[i + 1] ^ y[i + 1]
        return np.bitwise_count(low.view(np.uint64)) + np.bitwise_count(high.view(np.uint64))

    def close(self, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of places, which are close; the first two bits of the values decide for most."""
        kept = np.flatnonzero(self._apart(list(sketch[:4, a]), list(sketch[:4, b])) <= self.most[0])
        return kept[self._apart(list(sketch[:, a[kept]]), list(sketch[:, b[kept]])) <= self.most[1]]

    def pairs(self, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Places of all close pairs, or None as soon as they are more than ``most``."""
        found, total, begin, n = [], 0, 0, sketch.shape[1]
        while begin < n - 1:
            end = min(n, begin + max(1, BLOCK // (n - begin)))
            apart = self._apart([x[begin:end, None] for x in sketch[:4]], [x[None, begin:] for x in sketch[:4]])
            a, b = np.nonzero(apart <= self.most[0])
            a, b = a[a < b] + begin, b[a < b] + begin
            kept = self.close(sketch, a, b)
            total += len(kept)
            if total > most:
                return None
            found.append((a[kept], b[kept]))
            begin = end
        return tuple(np.concatenate(x) for x in zip(*found))


class Regions:
    """Candidates among rows that come in order of key, block by block; holds no more than a block and an open region.

    A region is a common tree and two common values.  With ``cut`` the first and
    the last region may go on in other tasks and are passed on as they are.
    ``sketched`` says which of the candidates of rows with sketches are any.
    """

    def __init__(self, cut: bool, room: int = ROOM, window: int = WINDOW, sketched: Sketched | None = None):
        self.cut, self.room, self.window, self.sketched = cut, room, window, sketched
        self.sketch = np.zeros((len(SKETCH) if sketched else 0, 0), np.int64)
        self.key, self.num, self.marked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.told = 0  # rows held that were told to be crowded before; only ever of a crowded open region
        self.first: int | None = None

    def add(self, key: np.ndarray, num: np.ndarray, marked: np.ndarray, last: bool = False, sketch: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """``(kind, a, b)`` arrays of what is known with these rows, and the sketches (columns x rows) of a cut region's.

        ``marked``: rows that only tell that their region is crowded.
        """
        key, num, marked = np.concatenate([self.key, key]), np.concatenate([self.num, num]), np.concatenate([self.marked, marked])
        sketch = self.sketch if sketch is None else np.concatenate([self.sketch, sketch], axis=1)
        with_sketch = (lambda rows: (sketch[:, rows],)) if self.sketched else lambda rows: ()
        if not len(key):
            return []
        region = key >> 24
        if self.first is None:
            self.first = int(region[0])
        begin = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        sizes = np.diff(np.r_[begin, len(key)])
        crowded = (sizes > self.room) | np.logical_or.reduceat(marked, begin)
        crowded[0] |= self.told > 0
        # The open region waits for its end unless it is known to be crowded.
        wait = 0 if last or crowded[-1] else int(sizes[-1])
        ready = len(key) - wait
        of = np.repeat(np.arange(len(begin)), sizes)[:ready]
        cut = np.zeros(len(begin), bool)
        if self.cut:
            cut[0] = int(region[0]) == self.first
            cut[-1] |= last
        out = []
        fresh = np.arange(ready) >= self.told
        real = ~marked[:ready]
        passed = cut[of] & ~crowded[of]
        if passed.any():
            out.append((np.full(passed.sum(), CUT), num[:ready][passed], key[:ready][passed], *with_sketch(np.flatnonzero(passed))))
        known = crowded[of] & fresh & real
        if known.any():
            out.append((np.full(known.sum(), CROWDED), num[:ready][known], num[:ready][known]))
        for i in np.flatnonzero(cut & crowded):
            out.append((np.array([CUT_CROWDED]), num[begin[i] : begin[i] + 1], key[begin[i] : begin[i] + 1], *with_sketch(begin[i : i + 1])))
        large = (sizes > SMALL) & ~crowded & ~cut & (begin < ready) if self.sketched else np.zeros(len(begin), bool)
        for i in np.flatnonzero(large):
            own = slice(begin[i], begin[i] + sizes[i])
            pairs = self.sketched.pairs(sketch[:, own], LOOKALIKES * int(sizes[i]))
            if pairs is None:
                out.append((np.full(sizes[i], CROWDED), num[own], num[own]))
            else:
                out.append((np.full(len(pairs[0]), CANDIDATE), num[own][pairs[0]], num[own][pairs[1]]))
        reach = np.where(crowded[of], self.window, np.where((cut | large)[of], 0, self.room))
        active, step = np.flatnonzero(real & (reach > 0)), 1
        while len(active):
            active = active[(reach[active] >= step) & (active + step < ready)]
            active = active[region[active] == region[active + step]]
            pair = active[(active + step >= self.told) & real[active + step]]
            if self.sketched:
                pair = pair[self.sketched.close(sketch, pair, pair + step)]
            out.append((np.full(len(pair), CANDIDATE), num[pair], num[pair + step]))
            step += 1
        held = wait if wait else 0 if last else min(int(sizes[-1]), self.window)
        self.told = held if not wait and not last else 0
        self.key, self.num, self.marked, self.sketch = key[len(key) - held :], num[len(key) - held :], marked[len(key) - held :], sketch[:, len(key) - held :]
        return out


def _pass_over(rows: DataFrame, cut: bool, room: int, threshold: float) -> DataFrame:
    """``(kind, a, b)`` of sorted ``(key, num, marked)`` rows with sketches, and the sketches of those that are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = Regions(cut, room, sketched=Sketched(threshold))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

        def told(found: list) -> Iterator[pa.RecordBatch]:
            for passed in (False, True):
                own = [x for x in found if len(x[0]) and (len(x) > 3) == passed]
                if own:
                    kind, a, b = (np.concatenate([x[i] for x in own]) for i in range(3))
                    columns = [pa.array(x) for x in np.concatenate([x[3] for x in own], axis=1)] if passed else [pa.nulls(len(kind), pa.int64())] * len(SKETCH)
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a), pa.array(b), *columns], names=["kind", "a", "b", *SKETCH])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(SKETCH))]
            yield from told(regions.add(*columns[:3], sketch=np.array(columns[3:])))
        yield from told(regions.add(*none, last=True))

    return rows.mapInArrow(run, f"kind int, a bigint, b bigint, {_SKETCH_DDL}")


def _tree_candidates(signed: DataFrame, trees: range, room: int, threshold: float) -> list[DataFrame]:
    """``(kind, a, b, ...)`` tables of the passes over some trees."""
    forest = signed.select(F.explode(F.array(*_keys(trees))).alias("key"), "num", *SKETCH)
    # The number is part of the range, so even a region of equal keys is cut into parts of like size.
    placed = forest.repartitionByRange("key", "num").sortWithinPartitions("key", "num")
    found = written_once(_pass_over(placed.select("key", "num", F.lit(False).alias("marked"), *SKETCH), True, room, threshold), "forest")
    # At most two regions of a task are cut, and of each so many rows come here as fit an uncrowded region.
    parts = found.where(F.col("kind").isin(CUT, CUT_CROWDED)).select(F.col("b").alias("key"), F.col("a").alias("num"), (F.col("kind") == CUT_CROWDED).alias("marked"), *SKETCH)
    parts = parts.repartition(F.shiftright("key", 24)).sortWithinPartitions("key", "num")
    return [found, written_once(_pass_over(parts, False, room, threshold), "cut-regions")]


def forest_candidates(signed: DataFrame, threshold: float, trees: int = TREES, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, a < b, of signed rows that are close neighbours in some tree, and the ``num`` of crowded ones."""
    at_once = max(AT_ONCE, ROWS_AT_ONCE // max(1, signed.count()))
    found = [t for i in range(0, trees, at_once) for t in _tree_candidates(signed, range(i, min(i + at_once, trees)), room, threshold)]
    rows = reduce(DataFrame.unionByName, (t.select("kind", "a", "b") for t in found))
    pairs = rows.where(F.col("kind") == CANDIDATE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written_once(pairs, "forest-candidates"), written_once(rows.where(F.col("kind") == CROWDED).select(F.col("a").alias("num")).distinct(), "crowded")
    dropped(*found)
    return both


def rare_first(batch: pa.RecordBatch, common: np.ndarray, threshold: float, part: int = 0, parts: int = 1) -> pa.RecordBatch:
    """The leading shingles of every record, common ones last: shingle, number, size, place, whether to index it, whether it is common, sketch.

    Only the shingles of one of ``parts`` parts come out.
    """
    num, hashes, starts = _shingle_lists(batch)
    size = np.diff(np.r_[starts, len(hashes)])
    of = np.repeat(np.arange(len(num)), size)
    held = np.isin(hashes, common)
    order = np.lexsort((hashes, held, of))
    place = np.arange(len(hashes)) - np.repeat(starts, size)
    n = size[of]
    probed = place < n - np.ceil(threshold * n - 1e-9) + 1
    index = place < n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1
    kept = np.flatnonzero(probed & (hashes[order] % np.uint64(parts) == part))
    columns = [pa.array(c[kept]) for c in (hashes[order].view(np.int64), num[of], n, place, index, held[order])]
    sketch = [batch.column(i).take(pa.array(of[kept])) for i in range(2, batch.num_columns)]
    return pa.RecordBatch.from_arrays([*columns, *sketch], names=["shingle", "num", "n", "place", "indexed", "common", *batch.schema.names[2:]])


def _exact_part(lists: DataFrame, threshold: float, common: np.ndarray, part: int, parts: int) -> DataFrame:
    """``(a, b)`` that ``exact_candidates`` has by one part of the shingles."""
    sketch = lists.columns[2:]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rare_first(batch, common, threshold, part, parts)

    columns = "".join(f", {c} bigint" for c in sketch)
    leading = written_once(lists.mapInArrow(rows, f"shingle bigint, num bigint, n bigint, place bigint, indexed boolean, common boolean{columns}"), "leading")
    salts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    x = leading.where("indexed").withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("num"), F.lit(SALT)).cast("int")).otherwise(0)).alias("x")
    y = leading.withColumn("salt", F.explode(salts)).alias("y")
    smaller = F.expr("x.n < y.n or (x.n = y.n and x.num < y.num)")
    rest = 1 + F.least(F.expr("x.n - x.place - 1"), F.expr("y.n - y.place - 1"))
    enough = (F.expr("x.n") >= threshold * F.expr("y.n") - 1e-9) & (rest >= threshold / (1 + threshold) * F.expr("x.n + y.n") - 1e-9)
    if sketch:
        differ = [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in sketch]
        apart = F.bit_count(reduce(Column.bitwiseOR, differ[::2])) + F.bit_count(reduce(Column.bitwiseOR, differ[1::2]))
        enough &= apart <= Sketched(threshold).most[1]
    joined = x.join(y, F.expr("x.shingle = y.shingle and x.salt = y.salt") & smaller & enough)
    pairs = written_once(joined.select(F.col("x.num").alias("a"), F.col("y.num").alias("b")).distinct(), "exact")
    dropped(leading)
    return pairs


def exact_candidates(lists: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, maybe repeated, with every pair of ``(num, shingles)`` rows whose similarity reaches the threshold.

    Of two such records the smaller one shares one of its first shingles to
    index with the first shingles of the other.  Joins by a common shingle are
    salted.  Pairs of rows that have sketches as well are of close ones.
    """
    total = lists.agg(F.sum(F.size("shingles"))).first()[0] or 0
    # What is common only orders the shingles, so one record of eight tells it if they are many.
    parts = min(PARTS, 1 + total // SHINGLES_A_PART)
    each = lists.where(F.pmod(F.xxhash64("num"), F.lit(parts)) == 0).select(F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").count().where(F.col("count") > max(COMMON_FROM, total // COMMON_MOST) / parts).select("shingle")
    common = np.array([r.shingle for r in often.collect()], np.int64).view(np.uint64)  # about COMMON_MOST at most, as each counts for more than total / COMMON_MOST
    found = [_exact_part(lists, threshold, common, part, parts) for part in range(parts)]
    pairs = written_once(reduce(DataFrame.unionByName, found), "exact-candidates")
    dropped(*found)
    return pairs


def verified(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs whose Jaccard similarity reaches the threshold."""
    of_a, of_b = lists.select(F.col("num").alias("a"), F.col("shingles").alias("of_a")), lists.select(F.col("num").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", F.size("of_a").alias("na"), F.size("of_b").alias("nb"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return both.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)


class NearDuplicates:
    """Near-duplicate classes and links of a collection.

    Null ids and texts are left out, a record in several rows counts once, and
    a record of fewer than ``size`` terms is in no pair.  ``members`` has one
    row per record with at least ``size`` terms: ``rec_id``, ``key`` of its term
    sequence.  ``links`` has ``(a, b, similarity)`` between the smallest ids of
    different classes.  An empty table gives empty results.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8, trees: int = TREES, room: int = ROOM):
        records = one_per_record(df, id_col, text_col).withColumn("terms", terms_column(F.col("text"))).where(F.size("terms") >= size)
        records = records.select("rec_id", F.concat_ws(" ", "terms").alias("words")).select("rec_id", F.md5(F.col("words").cast("binary")).alias("key"), "words")
        records = written_once(records, "records")
        first = records.groupBy("key").agg(F.min(F.struct("rec_id", "words")).alias("first"), F.count("*").alias("members"))
        # Pairs are of the numbers that rows of this table get once and for all: eight bytes, however long the ids are.
        first = first.select("key", "first.rec_id", "members", "first.words").withColumn("num", F.monotonically_increasing_id())
        first = written_once(first, "classes")
        self.members = written_once(records.select("rec_id", "key"), "members")
        dropped(records)
        listed = lambda rows: rows.select("num", F.split("words", " ").alias("terms")).select("num", shingles(F.col("terms"), size).alias("shingles"))
        signed = written_once(signed_rows(listed(first), trees), "signatures")
        near, crowded = forest_candidates(signed, threshold, trees, room)
        pairs = near
        if crowded.head(1):
            sketch = written_once(signed.select("num", *SKETCH).join(crowded, "num"), "crowded-sketches")
            dropped(signed)
            lists = written_once(listed(first.join(crowded, "num")).join(sketch, "num"), "crowded-lists")
            exact = exact_candidates(lists, threshold)
            dropped(lists, sketch)
            pairs = written_once(near.unionByName(exact.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "candidates")
            dropped(exact)
        dropped(signed)
        found = self._verified(first, pairs, listed, threshold)
        self.links = written_once(reduce(DataFrame.unionByName, found), "links")
        self.firsts = written_once(first.select("key", F.col("rec_id").alias("first"), "members"), "firsts")
        dropped(first, near, crowded, pairs, *found)

    @staticmethod
    def _verified(first: DataFrame, pairs: DataFrame, listed: Callable[[DataFrame], DataFrame], threshold: float) -> list[DataFrame]:
        """``(a, b, similarity)`` tables of smallest ids, of one part of the candidates after the other."""
        parts = min(VERIFIED_PARTS, 1 + CLASSES_A_CANDIDATE * pairs.count() // max(1, first.count()))
        a, b = (first.select(F.col("num").alias(c), F.col("rec_id").alias(f"id_{c}")) for c in ("a", "b"))
        out = []
        for part in range(parts):
            own = pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == part)
            asked = own.select(F.explode(F.array("a", "b")).alias("num")).distinct()
            lists = written_once(listed(first.join(asked, "num")), "candidate-lists")
            found = verified(own, lists, threshold).join(a, "a").join(b, "b")
            out.append(written_once(found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity"), "found"))
            dropped(lists)
        return out

    def _members(self, of: DataFrame) -> DataFrame:
        """``(rec_id, ...)`` of the members of some classes ``(key, ...)``, salted as one class may hold much of the table."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        salted = self.members.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALT)).cast("int"))
        return salted.join(of.withColumn("salt", salts), ["key", "salt"]).drop("key", "salt")

    def classes(self) -> DataFrame:
        """``(rec_id, first, members, links)``: every record, its class by its smallest id, the records of the class, and how many other classes are similar."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("links"))
        known = self.firsts.join(ends, "first", "left").select("key", "first", "members", F.coalesce("links", F.lit(0)).alias("links"))
        return self._members(known).select("rec_id", "first", "members", "links")

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """``(a, b)``, a < b by bytes, of all similar records.

        A class of more than ``expand`` equal records stands for its members:
        it gives the links of its smallest id to each of them and to other
        classes, not the pairs of all its members.  ``classes`` and ``links``
        have the whole without any such bound.
        """
        several = self.firsts.where("members > 1").select("key", "first", "members")
        small = self._members(several.where(F.col("members") <= expand)).groupBy("first").agg(F.sort_array(F.collect_list("rec_id")).alias("all"))
        of_a, of_b = small.toDF("a", "all_a"), small.toDF("b", "all_b")
        across = self.links.join(of_a, "a", "left").join(of_b, "b", "left")
        across = across.select(F.explode(F.coalesce("all_a", F.array("a"))).alias("a"), "b", "all_b").select("a", F.explode(F.coalesce("all_b", F.array("b"))).alias("b"))
        within = small.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
        star = self._members(several.where(F.col("members") > expand)).where("first <> rec_id").select(F.col("first").alias("a"), F.col("rec_id").alias("b"))
        both = across.unionByName(within).unionByName(star)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def groups(self) -> DataFrame:
        """``(rec_id, group_id)``: every record and the smallest id that it is linked to, directly or not.

        A record that is linked to none is its own group.
        """
        labels = components(self.links.select("a", "b"))
        firsts = self.firsts.join(labels.withColumnRenamed("node", "first"), "first", "left")
        named = firsts.select("key", F.coalesce("label", "first").alias("group_id"))
        return self._members(named).select("rec_id", "group_id")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of an edge table ``(a, b)``: the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so chains shorten to half; tables are written between rounds.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = written(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "before"), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> before").head(1):
            return labels
