"""Packing of tokenised documents into sequences by vector bin packing.

An example takes three resources of a sequence at once: tokens, segments and
loss-bearing tokens. The dot-product heuristic places examples: for an open
sequence, the waiting example whose demand vector has the largest dot product
with the sequence's remaining capacity, each resource weighted by its total
demand, goes next. Where cutting is allowed, the rest of a sequence that no
whole example fills takes the head of one; what is left at a partition's end
goes to sequences as long as powers of two, so that hardly any is padded.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import emit, held, in_arrow, small, strings

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64())])


@dataclass(frozen=True)
class Limits:
    """What a sequence can hold. ``pool``: examples that wait at once in a task."""

    tokens: int = 2048
    segments: int = 32
    loss_tokens: int = 2048
    pool: int = 128


def _ranks(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Bytes of each token of a byte-level vocabulary file, and the pairs that it merges, in order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    known = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown = {chr(b): b for b in known} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(known))}
    special = {x["content"] for x in model["added_tokens"]}
    raw = lambda w: bytes(shown[c] for c in w)
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["model"]["merges"]]
    return {raw(w): i for w, i in model["model"]["vocab"].items() if w not in special}, [(raw(a), raw(b)) for a, b in merges]


def merges_by_rank(path: str) -> bool:
    """Whether merging the pair with the lowest token id is the same as merging by the file's list, for every text.

    It is if ids rise along the list and each token, built alone from its bytes
    by lowest ids, ends with the pair that the list has for it: whenever two
    neighbours could join to a token in a text, their bytes have been merged as
    if alone, so they are that pair.
    """
    ranks, merges = _ranks(path)
    ids = [ranks[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or len(ranks) != len(merges) + 256:
        return False
    for pair in merges:
        parts = [bytes([x]) for x in b"".join(pair)]
        while len(parts) > 2:
            near = [ranks.get(x + y, len(ranks)) for x, y in zip(parts, parts[1:], strict=False)]
            at = near.index(min(near))
            if near[at] >= ranks[pair[0] + pair[1]]:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if tuple(parts) != pair:
            return False
    return True


def encoder(path: str, by_rank: bool):
    """Function from texts to their ids (little-endian unsigned 32-bit) by the vocabulary file at ``path``.

    If the file's merges go ``by_rank``, they are run by the tiktoken library,
    which is four times as fast on prose; else by the tokenizers library.
    Strings of special tokens in a text are ordinary text.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    if by_rank:
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path)[0], special_tokens={}).encode_to_numpy
        return lambda texts: [fast(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


@functools.cache
def _by_rank(path: str) -> bool:
    return merges_by_rank(path)


@dataclass(slots=True)
class Example:
    """What is left of a document's ids, from ``start`` on."""

    doc: int
    ids: bytes
    total: int
    bears: bool  # whether its tokens bear loss
    start: int = 0

    @property
    def length(self) -> int:
        return self.total - self.start

    def loss(self, length: int) -> int:
        """Loss-bearing tokens of its next ``length`` ones: the first token of a piece has nothing to be predicted from."""
        return length - 1 if self.bears else 0


class Packer:
    """Sequences of one task, filled one after another from a pool of waiting examples."""

    def __init__(self, limits: Limits, prefix: int) -> None:
        self.limits, self.next, self.prefix = limits, 0, prefix
        self.waiting: list[Example] = []
        self.rows: list[tuple] = []

    def put(self, x: Example, length: int, offset: int, segment: int) -> None:
        piece = memoryview(x.ids)[4 * x.start : 4 * (x.start + length)]
        self.rows.append((x.doc, x.start, length, zlib.crc32(piece), x.total, self.prefix + self.next, offset, segment, x.loss(length)))
        x.start += length

    def add(self, doc, ids: bytes, bears: bool = True) -> None:
        x = Example(doc, ids, len(ids) // 4, bears)
        full = min(self.limits.tokens, self.limits.loss_tokens + 1) if bears else self.limits.tokens
        while x.length >= full:
            self.put(x, full, 0, 0)
            self.next += 1
        if x.length:
            self.waiting.append(x)
            while len(self.waiting) >= self.limits.pool:
                self.fill(self.limits.tokens)

    def fill(self, tokens: int) -> None:
        """One sequence: whole examples by the dot-product rule, then the head of one more."""
        cap = np.array([tokens, self.limits.segments, self.limits.loss_tokens], float)
        need = np.array([(x.length, 1, x.loss(x.length)) for x in self.waiting], float) / cap
        weight = need.sum(0) / len(need)
        free, left, offset, segment = np.ones(3), np.ones(len(need), bool), 0, 0
        while True:
            fits = np.flatnonzero(left & (need <= free + 1e-9).all(1))
            if not len(fits):
                break
            best = int(fits[np.argmax(need[fits] @ (weight * free))])
            length = self.waiting[best].length
            self.put(self.waiting[best], length, offset, segment)
            free, offset, segment = free - need[best], offset + length, segment + 1
            left[best] = False
        self.waiting = [x for x, stays in zip(self.waiting, left, strict=True) if stays]
        room = {True: min(tokens - offset, round(free[2] * cap[2]) + 1), False: tokens - offset}
        cut = [x for x in self.waiting if room[x.bears] > 0]
        if cut and segment < self.limits.segments:
            x = max(cut, key=lambda x: min(x.length, room[x.bears]))
            self.put(x, min(x.length, room[x.bears]), offset, segment)
            self.waiting = [x for x in self.waiting if x.length]
        self.next += 1

    def finish(self) -> None:
        """The last sequences are powers of two long, which need no padding."""
        while self.waiting:
            left = sum(x.length for x in self.waiting)
            self.fill(self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1))

    def taken(self) -> dict:
        out = dict(zip(ARROW.names, zip(*self.rows, strict=True), strict=True)) if self.rows else {n: [] for n in ARROW.names}
        self.rows = []
        return out


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, bears: Column | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (columns doc_id and text; others are ignored).

    ``bears`` says of each row whether its tokens bear loss (for instruction
    data, the answers; null is no), all if it isn't given.

    A document's tokens are its ids and ``end_id``; a null or empty text has
    the end token alone. Each token lies in one piece; a text of any length is
    cut in time that grows with its length. Of examples with equal dot products
    the one that came first goes. Sequence numbers hold
    the partition's number in their upper bits. Repeated rows are packed once
    each; an empty table gives an empty result. Every task packs its own rows
    with one pass and a bounded pool, so nothing is shuffled and a lost task is
    simply run again.
    """

    by_rank = _by_rank(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = held(tokenizer, lambda: encoder(tokenizer, by_rank)), Packer(limits, TaskContext.get().partitionId() << 33), np.uint32(end_id).tobytes()
        for b in small(batches):
            for doc, tokens, loss in zip(b.column("doc_id").to_pylist(), encode(strings(b.column("text"))), b.column("bears").to_pylist(), strict=True):
                packer.add(doc, tokens + end, loss)
            yield from emit(ARROW, packer.taken())
        packer.finish()
        yield from emit(ARROW, packer.taken())

    loss = F.lit(True) if bears is None else F.coalesce(bears, F.lit(False))
    return in_arrow(docs.select("doc_id", "text", loss.alias("bears")), run, SCHEMA)
