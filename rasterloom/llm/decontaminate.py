"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size (number of distinct five-word shingles, in
powers of two). For each partition, a document's shingles are cut into windows
of twice the partition's largest size, half overlapping, so that a passage as
long as an item lies whole in a window however long the document is; a window's
MinHash is held against those of the partition's items, with bands of one row
and as many bands as the least similarity of the partition asks for. A hit is a
shared shingle, so candidates are few; each is verified by the exact
containment of the item's shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, emit, held, in_arrow, mix, salt, shingles, small, strings, words


@dataclass(frozen=True)
class Params:
    width: int = 5
    containment: float = 0.8
    #: Chance at most that MinHash misses an item that is contained to the threshold.
    miss: float = 1e-6
    #: Items that are held by a worker at once; a larger benchmark takes several passes.
    block_items: int = 50_000


def item_shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """Distinct shingles of each item; none for an item of fewer words than a shingle has."""
    h, bounds = words(texts)
    value, to = shingles(h, bounds, width)
    long_enough = np.diff(bounds) >= width
    return [np.unique(value[to[i] : to[i + 1]]) if long_enough[i] else value[:0] for i in range(len(texts))]


class Index:
    """MinHash tables of a block of items, by size partition."""

    def __init__(self, ids: list, texts: list[str], p: Params) -> None:
        self.ids, self.sets, self.p = ids, item_shingles(texts, p.width), p
        self.all = np.unique(np.concatenate([np.zeros(0, U64), *self.sets]))
        self.partitions = []
        size = np.array([len(s) for s in self.sets])
        for k in range(int(size.max(initial=0)).bit_length()):
            members = np.flatnonzero((size >= 2**k) & (size < 2 ** (k + 1)))
            if len(members):
                most, least = int(size[members].max()), int(size[members].min())
                shared = p.containment * least
                window = 2 * most
                jaccard = shared / (window + least - shared)
                bands = int(np.ceil(np.log(p.miss) / np.log1p(-jaccard)))
                table: dict[tuple[int, int], list[int]] = {}
                for m in members:
                    for b, value in enumerate(self._minhash(self.sets[m], bands)):
                        table.setdefault((b, value), []).append(int(m))
                self.partitions.append((most, bands, table))

    @classmethod
    def of(cls, key: str, ids: list, texts: list[str], p: Params) -> Index:
        return held((key, p), lambda: cls(ids, texts, p))

    @staticmethod
    def _minhash(values: np.ndarray, bands: int) -> list[int]:
        return [int(mix(values ^ salt(b + 1)).min()) for b in range(bands)]

    def search(self, value: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of each item that is contained in a document with these shingles."""
        at = np.searchsorted(self.all, value)
        known = np.flatnonzero(self.all[np.minimum(at, len(self.all) - 1)] == value) if len(self.all) else at[:0]
        if not len(known):
            return []
        found: set[int] = set()
        for most, bands, table in self.partitions:
            # A window without any item's shingle can share no MinHash with an item.
            for w in np.unique(np.concatenate([known // most, known // most - 1])):
                begin = max(0, int(w) * most)
                for b, least in enumerate(self._minhash(np.unique(value[begin : (int(w) + 2) * most]), bands)):
                    found.update(table.get((b, least), ()))
        have = np.unique(value[known])
        out = []
        for m in sorted(found):
            shared = len(np.intersect1d(self.sets[m], have, assume_unique=True))
            if shared >= self.p.containment * len(self.sets[m]) - 1e-9:
                out.append((m, shared))
        return out


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])


def _blocks(benchmark: DataFrame, p: Params) -> Iterator[tuple[str, list, list[str], list[int]]]:
    """The items in blocks of a checked size, each collected to be broadcast: ids, texts, and how often each item is there.

    Repeated items are one, so that a block has about ``block_items`` whatever is repeated.
    """
    items = benchmark.where(F.col("text").isNotNull()).groupBy("item_id", "text").agg(F.count("*").alias("n"))
    parts = max(1, -(-items.count() // p.block_items))
    for n in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).collect()
        yield f"{n} of {parts}: {hash(tuple(rows))}", [r.item_id for r in rows], [r.text for r in rows], [r.n for r in rows]


def _search(b: pa.RecordBatch, index: Index) -> list[list[tuple[int, int]]]:
    h, bounds = words(strings(b.column("text")))
    value, to = shingles(h, bounds, index.p.width)
    return [index.search(value[to[i] : to[i + 1]]) if bounds[i + 1] - bounds[i] >= index.p.width else [] for i in range(b.num_rows)]


def contained(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment: each item (item_id, text) found in each row (doc_id, text).

    Containment is the share of the item's distinct five-word shingles that the
    whole text has. Texts and items of fewer than five words, or null, have no
    shingle and are in no result; equal items are each reported, and so are
    repeated rows. An empty table on either side gives an empty result; extra
    columns are ignored. One narrow pass over the documents for each block of
    items.
    """
    out = None
    for key, ids, texts, times in _blocks(benchmark, p):
        shared = docs.sparkSession.sparkContext.broadcast((key, ids, texts, times))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, times = Index.of(*shared.value[:3], p), shared.value[3]
            for b in small(batches):
                doc = b.column("doc_id").to_pylist()
                hits = [(doc[i], index.ids[m], len(index.sets[m]), n, n / len(index.sets[m])) for i, found in enumerate(_search(b, index)) for m, n in found for _ in range(times[m])]
                if hits:
                    yield from emit(OUT, dict(zip(OUT.names, zip(*hits, strict=True), strict=True)))

        part = in_arrow(docs.select("doc_id", "text"), run, "doc_id long, item_id long, item_shingles long, shared long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows of ``docs``, all columns, in which no item is contained.

    Null, empty and very short texts contain none and stay, and so does all if
    the benchmark is empty; a text of any length is searched whole. Repeated
    rows stay or go together; an empty table gives an empty result. Columns of
    any name stay as they are.
    """
    for key, ids, texts, _ in _blocks(benchmark, p):
        shared = docs.sparkSession.sparkContext.broadcast((key, ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(*shared.value, p)
            for b in small(batches):
                yield b.filter(pa.array([not found for found in _search(b, index)], pa.bool_()))

        docs = in_arrow(docs, run, docs.schema)
    return docs
