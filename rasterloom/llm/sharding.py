"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers in the order (doc_id, checksum, size); a keyed Feistel
network over a power-of-four domain, with cycle walking back into the row
range, permutes them. Shard and slot are remainder and quotient of the permuted
number, so both can be computed from a row number alone, shard counts differ by
one at most and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, cut, emit, mix, shuffle_width

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, row_number long"
ARROW = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("law", pa.string()), ("shard", pa.int32()), ("slot", pa.int64()), ("grown_shard", pa.int32()), ("row_number", pa.int64())])


def permute(numbers: np.ndarray, total: int, seed: int = 17, rounds: int = 6) -> np.ndarray:
    """Place of each row number in [0, total) under the keyed permutation of that range."""
    half = U64(max(1, ((max(total, 2) - 1).bit_length() + 1) // 2))
    mask = (U64(1) << half) - U64(1)

    keys = mix(np.arange(1, rounds + 1, dtype=U64) + U64(seed << 32))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + keys[r]) & mask)
        return (left << half) | right

    out = once(numbers.astype(U64))
    while len(outside := np.flatnonzero(out >= U64(total))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """A shard, and a slot in it, for each row of ``docs`` (columns doc_id and text; others are ignored).

    Law ``rows``: shard counts differ by one at most. A null text counts as
    empty (size 1, checksum 0). Rows with a null doc_id come first in the row
    order. Repeated rows each get a place of their own; as they are alike, it
    doesn't matter which. An empty table gives an empty result. Only ids, sizes
    and checksums are shuffled; the driver gets one count for each partition.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["doc_id", "text_crc32", "size"]
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    dealt = small.repartitionByRange(shuffle_width(docs.sparkSession), *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut(dealt.select("*", F.spark_partition_id().alias("part"), low.alias("place")), docs.count())
    counts = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    begin = np.zeros(max(counts, default=0) + 2, np.int64)
    np.cumsum([counts.get(p, 0) for p in range(len(begin) - 1)], out=begin[1:])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = begin[b.column("part").to_numpy()] + b.column("place").to_numpy()
            at = permute(number, total, seed)
            n = len(at)
            yield from emit(ARROW, {"doc_id": b.column("doc_id"), "size": b.column("size"), "text_crc32": b.column("text_crc32"), "law": ["rows"] * n, "shard": at % shards, "slot": at // shards, "grown_shard": [None] * n, "row_number": number})

    return numbered.mapInArrow(place, SCHEMA)
