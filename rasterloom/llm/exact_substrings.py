"""Exact removal of repeated byte strings by a distributed suffix sort.

A byte is removed if a string of ``length`` bytes that covers it starts
anywhere else too. Sorting every suffix of the corpus would move each byte
hundreds of times, so only suffixes at anchors are sorted, and only those that
can have an equal:

1. Equal texts are counted and one of each goes on; where there are several,
   all their bytes are repeated.
2. Each window (string of ``length`` bytes) has an anchor, the smallest hash in
   its first ``span`` places. The windows with one anchor are a context: its
   bytes reach from its first window's start to its last window's end. All hold
   the core, the ``length - span + 1`` bytes from the anchor on. Equal windows
   have equal cores; anchors whose core (by its hash) occurs once are dropped.
   The hash only drops what has no equal: what is left is decided by its bytes.
3. The suffixes at the anchors left are range-partitioned by leading tokens
   (24 bytes, then the core) with sampled splitters. Each bucket orders its
   suffixes by multikey quicksort over tokens of eight bytes, and the texts
   before the anchors, read backwards, likewise. For each distance of a window
   start before the anchor, neighbours with a long enough common prefix in both
   orders are classes of equal windows.
4. A bucket never has more than ``hot`` contexts of one core: those of a hotter
   core are merged by content, and the windows of what occurs once are suffixes
   of their own, range-partitioned by leading tokens and content one by one, so
   that equal ones may lie in several buckets; those at the edges of buckets are
   compared across the boundary. Here content is a 128-bit BLAKE2 digest.

The same suffixes tell which windows of a second, shorter length are repeated:
windows that begin at one place have one anchor, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, cut, cut_counting, emit, fresh, held, in_arrow, limited, mix, salt, shuffle_width, signed, small

LOW = U64(0xFFFFFFFF)
#: In a list of starts: every window of the text is repeated.
ALL = -1


@dataclass(frozen=True)
class Params:
    length: int = 400
    span: int = 128  # a power of two, 128 at most
    #: ``remove`` leaves runs of fewer words alone.
    words: int = 0
    #: A second length to report on, of ``length`` at most; runs of fewer than ``passage_words`` words are no passages.
    passage: int = 0
    passage_words: int = 51
    #: Contexts of one core that a bucket takes at most; beyond, each window is dealt alone.
    hot: int = 1024
    bucket_contexts: int = 10_000
    #: Bytes that are hashed at once.
    piece: int = 250_000
    lead: int = 24
    #: Rows of a broadcast side at most (about 100 bytes each in memory).
    broadcast_rows: int = 50_000
    #: The same for sides that are two keys of a text alone.
    broadcast_keys: int = 200_000

    @property
    def least(self) -> int:
        return self.passage or self.length

    @property
    def core(self) -> int:
        return self.least - self.span + 1

    @property
    def lengths(self) -> tuple[int, ...]:
        """Lengths of windows; starts say by their last bit which it is."""
        return (self.length, self.passage) if self.passage else (self.length,)


# -- anchors


class Prefix:
    """Polynomial prefix hashes of a byte array: any substring's hash in constant time. Equal strings have equal hashes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        size = 1 << max(20, n.bit_length())
        letter, powers, self.inverse = held(("powers", size), lambda: self.powers(size))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(letter[data] * powers[:n], out=self.sums[1:])

    @staticmethod
    def powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A random odd number for each byte, and the powers of a base and of its inverse."""
        base = U64(int(salt(3)) | 5)
        powers, inverse = np.full(size, base, U64), np.full(size, pow(int(base), -1, 1 << 64), U64)
        powers[0] = inverse[0] = 1
        return mix(np.arange(1, 257, dtype=U64) * salt(11)) | U64(1), np.multiply.accumulate(powers), np.multiply.accumulate(inverse)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=ends[1:])
    return np.frombuffer(b"".join(raw), np.uint8), ends


def pieces(texts: list, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, row of each piece, its offset) of runs of texts with about ``p.piece`` bytes; texts shorter than a window are left out.

    A long text is cut into pieces that overlap by one byte less than a window, so each window start is in one piece.
    """
    encoded = ((i, t.encode() if t else b"") for i, t in enumerate(texts))
    cut_up = ((i, a, raw[a : a + p.piece + p.least - 1]) for i, raw in encoded for a in range(0, len(raw) - p.least + 1, p.piece))
    held_back: list[tuple[int, int, bytes]] = []
    size = 0
    for x in cut_up:
        if held_back and size + len(x[2]) > 2 * p.piece:
            yield *joined([y for _, _, y in held_back]), np.array([i for i, _, _ in held_back]), np.array([a for _, a, _ in held_back])
            held_back, size = [], 0
        held_back.append(x)
        size += len(x[2])
    if held_back:
        yield *joined([y for _, _, y in held_back]), np.array([i for i, _, _ in held_back]), np.array([a for _, a, _ in held_back])


def anchors(data: np.ndarray, ends: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each context."""
    n = len(data)
    if n < p.least:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    key = np.empty(n, U64)
    for k in range(8):
        of = key[k::8]
        of[:] = padded[k : k + 8 * len(of)].view("<u8")
    key = (mix(key) & ~LOW) | np.arange(n, dtype=U64)
    step = 1
    while step < p.span:  # the least of 2, 4, 8 ... places, the leftmost on ties
        least = key.copy()
        np.minimum(key[:-step], key[step:], out=least[:-step])
        key, step = least, 2 * step
    anchor = (key & LOW).astype(np.int64)
    whole = np.repeat(ends[1:], np.diff(ends)) - np.arange(n) >= p.least
    changed = np.ones(n + 1, bool)
    changed[1:n] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | ~whole[1:]
    first = np.flatnonzero(whole & changed[:n])
    last = np.flatnonzero(whole & changed[1:])
    return anchor[first], first, last


#: A context's place: its first start, the anchor's distance from it, and the last start's.
ANCHORS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("part", pa.int64()), ("cores", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
ANCHORS_DDL = "t1 long, t2 long, part long, cores array<long>, places array<long>"


def _anchors(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        t1, t2 = b.column("t1").to_numpy(), b.column("t2").to_numpy()
        for data, ends, row, offset in pieces(b.column("text").to_pylist(), p):
            at, first, last = anchors(data, ends, p)
            piece = np.searchsorted(ends, first, "right") - 1
            place = (first - ends[piece] + offset[piece]) << 14 | (at - first) << 7 | (last - first)
            to = pa.array(np.searchsorted(piece, np.arange(len(row) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (signed(Prefix(data).of(at, at + p.core)), place)]
            yield from emit(ANCHORS, {"t1": t1[row], "t2": t2[row], "part": offset, "cores": lists[0], "places": lists[1]})


# -- suffixes at anchors, by their bytes

SUFFIXES = pa.schema([("lead", pa.binary()), ("core", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
SUFFIXES_DDL = "lead binary, core long, t1 long, t2 long, place long, bytes binary"
RUNS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("starts", pa.list_(pa.int64()))])
RUNS_DDL = "t1 long, t2 long, starts array<long>"


def _by_text(t1: np.ndarray, t2: np.ndarray, start: np.ndarray) -> dict:
    """The starts of each text as a list."""
    order = np.lexsort((t2, t1))
    t1, t2, start = t1[order], t2[order], start[order]
    new = np.ones(len(t1), bool)
    new[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    begin = np.flatnonzero(new)
    return {"t1": t1[begin], "t2": t2[begin], "starts": pa.ListArray.from_arrays(np.append(begin, len(t1)).astype(np.int32), pa.array(start))}


def _wanted(batches: Iterator[pa.RecordBatch], p: Params, most: int) -> Iterator[list[tuple]]:
    """(core, t1, t2, place, bytes) of the contexts wanted of each text, in lists of about ``most`` bytes."""
    out: list[tuple] = []
    size = 0
    for b in small(batches):
        for text, t1, t2, wanted in zip(*(b.column(n).to_pylist() for n in ("text", "t1", "t2", "wanted")), strict=True):
            raw = text.encode()
            for w in wanted:
                place = w["place"]
                first, last = place >> 14, (place >> 14) + (place & 127)
                out.append((w["core"], t1, t2, place, raw[first : last + p.length]))
                size += last - first + p.length
            if size > most:
                yield out
                out, size = [], 0
    yield out


def _suffixes(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for rows in _wanted(batches, p, 2_000_000):
        core, t1, t2, place, raw = zip(*rows, strict=True) if rows else ((),) * 5
        lead = [x[y >> 7 & 127 :][: p.lead] for x, y in zip(raw, place, strict=True)]
        yield from emit(SUFFIXES, {"lead": lead, "core": core, "t1": t1, "t2": t2, "place": place, "bytes": raw})


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of rows by their tokens (columns): quicksort by the first one, then each run of ties by the next, all runs of a depth at once."""
    order = np.argsort(tokens[:, 0], kind="stable")
    n = len(order)
    new = np.ones(n + 1, bool)  # where a run of ties begins
    first = tokens[order, 0]
    new[1:n] = first[1:] != first[:-1]
    for depth in range(1, tokens.shape[1]):
        at = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(at):
            break
        inner = ~new[at[1:]]
        token = tokens[order[at], depth]
        if ((token[1:] != token[:-1]) & inner).any():
            by = np.lexsort((token, np.cumsum(new[:n])[at]))
            order[at] = order[at[by]]
            token = token[by]
            new[at[1:]] |= (token[1:] != token[:-1]) & inner
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 4096):
        b = min(a + 4096, len(order))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes that stand from ``begin`` on in direction ``step``, with zeros after the first ``size``."""
    out = np.zeros((len(begin), -(-width // 8) * 8), np.uint8)
    for a in range(0, len(begin), 4096):
        part, k = slice(a, a + 4096), np.arange(width)
        inside = k < size[part, None]
        out[part, :width] = np.where(inside, data[np.where(inside, begin[part, None] + step * k, 0)], 0)
    return out


def _tokens(rows: np.ndarray) -> np.ndarray:
    return rows.view(">u8").astype(U64)


def repeated_windows(raw: list[bytes], place: np.ndarray, p: Params) -> list[np.ndarray]:
    """For each length, and each context (its bytes and its place): is its window at each distance from the anchor equal to another context's?"""
    n = len(raw)
    data, ends = joined(raw)
    furthest = place >> 7 & 127
    nearest = furthest - (place & 127)
    anchor = ends[:-1] + furthest
    beyond = np.diff(ends) - furthest  # bytes from the anchor on
    after, before = _gathered(data, anchor, np.minimum(beyond, p.length), p.length, 1), _gathered(data, anchor - 1, furthest, p.span, -1)
    on, back = multikey_order(_tokens(after)), multikey_order(_tokens(before))
    shared_on, shared_back = common_prefixes(after, on), common_prefixes(before, back)
    nearby = np.empty(n, np.int64)
    nearby[on] = np.maximum(shared_on, np.append(shared_on[1:], 0))
    ahead, behind, out = np.empty(n, np.int64), np.empty(n, np.int64), []
    for length in p.lengths:
        found = np.zeros((n, p.span), bool)
        near = np.maximum(nearest, length - beyond)  # a window ends in its text
        hopeful = nearby > length - p.span  # what shares no more with a neighbour is left out
        for d in range(p.span):
            pick = np.flatnonzero(hopeful & (near <= d) & (d <= furthest))
            if len(pick) < 2:
                continue
            ahead[on] = np.cumsum(shared_on < length - d)
            behind[back] = np.cumsum(shared_back < d)
            both = ahead[pick] * (n + 1) + behind[pick]
            order = np.argsort(both)
            same = np.zeros(len(pick) + 1, bool)
            same[1:-1] = both[order][1:] == both[order][:-1]
            found[pick[order], d] = same[1:] | same[:-1]
        out.append(found)
    return out


def _start(first, more, kind: int):
    """A run of starts as one number."""
    return (first << 20 | more) << 1 | kind


def _bucket(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket's suffixes and reports the starts of repeated windows."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    t1, t2, place = (table.column(n).to_numpy() for n in ("t1", "t2", "place"))
    for kind, found in enumerate(repeated_windows(table.column("bytes").to_pylist(), place, p)):
        edge = np.zeros((len(found), p.span + 2), np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        row, near = np.nonzero(step == 1)
        far = np.nonzero(step == -1)[1] - 1
        first = (place >> 14)[row] + (place >> 7 & 127)[row] - far
        yield from emit(RUNS, _by_text(t1[row], t2[row], _start(first, far - near, kind)))


# -- hot cores: contexts and windows by their content

#: A row for each content in a batch (of its first bearer), and one for each text whose starts are known to be repeated.
CONTEXTS = pa.schema([("content", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary()), ("alone", pa.bool_()), ("known", pa.list_(pa.int64()))])
CONTEXTS_DDL = "content binary, t1 long, t2 long, place long, bytes binary, alone boolean, known array<long>"
WINDOWS = pa.schema([("lead", pa.binary()), ("content", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("alone", pa.bool_()), ("known", pa.list_(pa.int64()))])
WINDOWS_DDL = "lead binary, content binary, t1 long, t2 long, start long, alone boolean, known array<long>"
EDGES = pa.schema([*RUNS, ("content", pa.binary()), ("repeated", pa.bool_())])


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _columns(names: list[str], rows: list[tuple]) -> dict[str, tuple]:
    return dict(zip(names, zip(*rows, strict=True), strict=True))


def _all_starts(place: int, size: int, p: Params) -> list[int]:
    """The runs of all windows of a context with ``size`` bytes."""
    ends = [min(place & 127, size - length) for length in p.lengths]
    return [_start(place >> 14, more, kind) for kind, more in enumerate(ends) if more >= 0]


def _contexts(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Each content of a list once. What bears a content that is there twice is known to be repeated."""
    for rows in _wanted(batches, p, 2_000_000):
        seen: dict[bytes, list] = {}
        known: dict[tuple[int, int], list[int]] = {}
        for _, t1, t2, place, raw in rows:
            content = _digest((place & 0x3FFF).to_bytes(2, "big") + raw)
            if content not in seen:
                seen[content] = [t1, t2, place, raw, True]
                continue
            known.setdefault((t1, t2), []).extend(_all_starts(place, len(raw), p))
            x = seen[content]
            if x[4]:
                known.setdefault((x[0], x[1]), []).extend(_all_starts(x[2], len(raw), p))
                x[4] = False
        out = [(c, *x, None) for c, x in seen.items()] + [(None, *k, None, None, None, v) for k, v in known.items()]
        if out:
            yield from emit(CONTEXTS, _columns(CONTEXTS.names, out))


def _windows(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Single windows of contexts. Of equal ones in a batch one is dealt; that the others, if alone, are repeated is known."""
    for b in small(batches, "bytes", 500_000):
        out: dict[bytes, list] = {}
        known: dict[tuple[int, int], list[int]] = {}
        for t1, t2, place, raw, alone in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "place", "bytes", "alone")), strict=True):
            for kind, length in enumerate(p.lengths):
                for k in range(min(place & 127, len(raw) - length) + 1):
                    w = raw[k : k + length]
                    content, start = _digest(w), _start((place >> 14) + k, 0, kind)
                    x = out.get(content)
                    if x is None:
                        out[content] = [w[: p.lead], t1, t2, start, alone]
                        continue
                    if alone:
                        known.setdefault((t1, t2), []).append(start)
                    if x[4]:
                        known.setdefault((x[1], x[2]), []).append(x[3])
                        x[4] = False
        rows = [(x[0], c, *x[1:], None) for c, x in out.items()] + [(b"", b"", *k, 0, True, v) for k, v in known.items()]
        if rows:
            yield from emit(WINDOWS, _columns(WINDOWS.names, rows))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket of single windows and reports repeated ones, and those at its edges."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    t1, t2, start, alone = (table.column(n).to_numpy() for n in ("t1", "t2", "start", "alone"))
    known = table.column("known").to_pylist()
    told = np.flatnonzero([k is not None for k in known])
    yield from emit(EDGES, {"t1": t1[told], "t2": t2[told], "starts": [known[i] for i in told], "content": [None] * len(told), "repeated": np.ones(len(told), bool)})
    rows = np.flatnonzero([k is None for k in known])
    content, lead = (table.column(n).take(pa.array(rows)).to_pylist() for n in ("content", "lead"))
    t1, t2, start, alone = t1[rows], t2[rows], start[rows], alone[rows]
    keys = np.frombuffer(b"".join(a.ljust(40, b"\0") + c for a, c in zip(lead, content, strict=True)), np.uint8).reshape(len(rows), 56)
    order = multikey_order(_tokens(keys))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (keys[order[1:]] == keys[order[:-1]]).all(1)
    repeated, edge = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeated[order] = same[1:] | same[:-1]
    edge[order[:1]] = edge[order[-1:]] = True
    pick = np.flatnonzero(edge)
    yield from emit(EDGES, {"t1": t1[pick], "t2": t2[pick], "starts": [[x] for x in start[pick]], "content": [content[i] for i in pick], "repeated": (repeated & alone)[pick]})
    pick = np.flatnonzero(repeated & alone & ~edge)
    found = _by_text(t1[pick], t2[pick], start[pick])
    yield from emit(EDGES, found | {"content": [None] * len(found["t1"]), "repeated": np.ones(len(found["t1"]), bool)})


def _hot(need: DataFrame, p: Params) -> DataFrame:
    """t1, t2, starts of repeated windows among the contexts of hot cores."""
    found = cut(in_arrow(need, lambda it: _contexts(it, p), CONTEXTS_DDL))
    told = found.where("known is not null").select("t1", "t2", F.col("known").alias("starts"))
    found = found.where("known is null")
    first = [F.first(c).alias(c) for c in ("t1", "t2", "place", "bytes", "alone")]  # all of one row
    kinds, n = cut_counting(found.groupBy("content").agg(F.count("*").alias("n"), *first), F.col("n") > 1)
    several = limited(kinds.where("n > 1").select("content"), n, p.broadcast_rows)
    first, more = F.shiftright("place", 14), F.col("place").bitwiseAND(F.lit(127)).cast("long")
    ends = [F.least(more, F.octet_length("bytes") - length) for length in p.lengths]
    runs = [F.when(x >= 0, F.shiftleft(F.shiftleft(first, 20).bitwiseOR(x), 1).bitwiseOR(F.lit(kind).cast("long"))) for kind, x in enumerate(ends)]
    equal = found.where("alone").join(several, "content", "left_semi").select("t1", "t2", F.array_compact(F.array(*runs)).alias("starts"))
    windows = in_arrow(kinds.select("t1", "t2", "place", "bytes", (F.col("alone") & (F.col("n") == 1)).alias("alone")), lambda it: _windows(it, p), WINDOWS_DDL)
    buckets = windows.repartitionByRange(max(shuffle_width(need.sparkSession), kinds.count() * p.span // (16 * p.bucket_contexts)), "lead", "content", "t1", "start")  # equal ones by the hash of their text
    runs = cut(in_arrow(buckets, _compared, f"{RUNS_DDL}, content binary, repeated boolean"))
    met = runs.where("content is not null").groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    # an edge's window that isn't alone needs no report, but a second one: every start that it stands for is known
    across = runs.where("content is not null and not repeated").join(met, "content", "left_semi")
    return told.unionByName(equal).unionByName(runs.where("repeated").select("t1", "t2", "starts")).unionByName(across.select("t1", "t2", "starts"))


# -- all together


def text_keys(docs: DataFrame, t1: str = "t1", t2: str = "t2") -> DataFrame:
    """Adds two keys, which together name a text."""
    return docs.withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(7), "text", F.lit(11))})


def repeated_starts(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, starts) of each text with repeated windows, as numbers of ``_start`` or ALL, and (t1, t2) of texts with very many copies.

    ``docs`` has t1, t2 and text. The second table has less than 100,000 rows.
    """
    docs = docs.select("t1", "t2", "text").where(F.octet_length("text") >= p.least)
    found = in_arrow(docs, lambda it: _anchors(it, p), ANCHORS_DDL)
    texts, parts = cut_counting(found.groupBy("t1", "t2", "part").agg(F.count("*").alias("n"), F.first("cores").alias("cores"), F.first("places").alias("places")))
    rows = texts.where("part = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = texts.where((F.col("n") > max(1, rows // 100_000)) & (F.col("part") == 0)).select("t1", "t2")
    whole = texts.where("n > 1 and part = 0").select("t1", "t2", F.array(F.lit(ALL).cast("long")).alias("starts"))
    each = texts.select("t1", "t2", F.explode(F.arrays_zip("cores", "places")).alias("x")).select("t1", "t2", F.col("x.cores").alias("core"), F.col("x.places").alias("place"))
    cores = cut(each.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    starts = whole
    for which, hot in ((F.col("n") <= p.hot, False), (F.col("n") > p.hot, True)):
        n, total = cores.where(which).agg(F.count("*"), F.sum("n")).first()  # hot cores are few: all contexts needn't be moved to meet them
        if not total:
            continue
        wanted = each.join(limited(cores.where(which).select("core"), n, p.broadcast_rows), "core", "left_semi")
        wanted, m = cut_counting(wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("core", "place")).alias("wanted")), rows=parts, each=10_000)
        need = docs.join(limited(wanted.select("t1", "t2"), m, p.broadcast_keys), ["t1", "t2"], "left_semi")
        need = need.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted.hint("shuffle_hash"), ["t1", "t2"])
        if hot:
            starts = starts.unionByName(_hot(need, p))
        else:
            suffixes = in_arrow(need, lambda it: _suffixes(it, p), SUFFIXES_DDL)
            buckets = suffixes.repartitionByRange(max(shuffle_width(docs.sparkSession), total // p.bucket_contexts), "lead", "core")
            starts = starts.unionByName(in_arrow(buckets, lambda it: _bucket(it, p), RUNS_DDL))
    return starts.groupBy("t1", "t2").agg(F.flatten(F.collect_list("starts")).alias("starts")), many


def spans(raw: bytes, starts: list[int], p: Params, kind: int = 0) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows of one length that begin at these starts."""
    length = p.lengths[kind]
    if ALL in starts:
        return [(0, len(raw))] if len(raw) >= length else []
    out: list[list[int]] = []
    for first, last in sorted((s >> 21, (s >> 21) + (s >> 1 & 0xFFFFF)) for s in starts if s & 1 == kind):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def passages(raw: bytes, starts: list[int], p: Params) -> list[tuple[int, int]]:
    """Repeated runs by the second length that have words enough (parted by ASCII white space)."""
    return [(a, b) for a, b in spans(raw, starts, p, 1) if len(raw[a:b].split()) >= p.passage_words] if p.passage else []


def kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in removed:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def with_starts(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, str]:
    """``docs`` with one column more, the starts of repeated windows (null where nothing is repeated), and its name.

    Rows whose text has more copies than a hundred-thousandth of all rows meet
    a broadcast mark, so that no task gets all copies of a text.
    """
    keys, name = [fresh(docs.columns, "t1"), fresh(docs.columns, "t2")], fresh(docs.columns, "starts")
    keyed = text_keys(docs, *keys)
    starts, many = repeated_starts(keyed.select(F.col(keys[0]).alias("t1"), F.col(keys[1]).alias("t2"), "text"), p)
    starts, many = starts.toDF(*keys, name).hint("shuffle_hash"), F.broadcast(many.toDF(*keys))
    rest = keyed.join(many, keys, "left_anti").join(starts, keys, "left").select(*docs.columns, name)
    copies = keyed.join(many, keys, "left_semi").select(*docs.columns, F.array(F.lit(ALL).cast("long")).alias(name))
    return rest.unionByName(copies), name


DIGEST = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("n_passages", pa.int64())])
DIGEST_DDL = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, n_passages long"


def duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ([begin, end) in bytes), n_passages of each row (columns doc_id and text; others are ignored).

    n_passages counts the repeated runs by windows of ``passage`` bytes that
    have ``passage_words`` words at least; they are reported, not removed (0 if
    there is no second length). A null text is empty; a text shorter than ``length`` bytes keeps all. A
    text of any length is read whole, in pieces that overlap. Rows repeated,
    with doc_id or without, repeat each other's bytes. An empty table gives an
    empty result. All occurrences go, so there are no ties.

    Only texts that keep a part are moved; of the other rows their keys are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out: dict[str, list] = {n: [] for n in DIGEST.names}
            for t1, t2, text, starts in zip(*(b.column(n).to_pylist() for n in ("t1", "t2", "text", "starts")), strict=True):
                raw = text.encode()
                cuts = spans(raw, starts, p)
                values = (t1, t2, sum(y - x for x, y in cuts), len(cuts), hashlib.sha256(kept(raw, cuts)).hexdigest(), cuts, len(passages(raw, starts, p)))
                for n, v in zip(out, values, strict=True):
                    out[n].append(v)
            yield from emit(DIGEST, out)

    keys = ["t1", "t2"]
    keyed = text_keys(docs.select("doc_id", "text"))
    starts, many = repeated_starts(keyed, p)
    starts = cut(starts.withColumn("whole", F.array_contains("starts", ALL)))
    parts = starts.where("not whole").select(*keys, "starts")
    need = keyed.where(F.octet_length("text") >= p.least).join(limited(parts.select(*keys), parts.count(), p.broadcast_keys), keys, "left_semi")
    parts = in_arrow(need.groupBy(*keys).agg(F.first("text").alias("text")).join(parts.hint("shuffle_hash"), keys), run, DIGEST_DDL).withColumn("whole", F.lit(False))
    found = starts.where("whole").select(*keys, "whole").unionByName(parts, allowMissingColumns=True)
    raw = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(raw, F.lit(r"[^ \t\n\r\x0b\f]+"), F.lit(0))) if p.passage else F.lit(0)
    rows = keyed.select("doc_id", *keys, F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), (words >= p.passage_words).alias("wordy"))
    copies = rows.join(F.broadcast(many), keys, "left_semi").withColumn("whole", F.lit(True))
    rows = rows.join(F.broadcast(many), keys, "left_anti").join(found, keys, "left").unionByName(copies, allowMissingColumns=True)
    none, length, gone = F.lit(0).cast("long"), F.col("n_bytes"), F.col("whole") & (F.col("n_bytes") >= p.length)
    passage = (F.col("wordy") & (F.col("n_bytes") >= p.least)).cast("long") if p.passage else none
    return rows.select(
        "doc_id", "n_bytes",
        F.when(gone, length).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.array(none, length))).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
        F.when(F.col("whole"), passage).otherwise(F.coalesce("n_passages", none)).alias("n_passages"),
    )


def remove(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows of ``docs``, all columns, with the repeated bytes cut out of text and n_chars counted anew.

    Runs of fewer than ``words`` words (parted by ASCII white space) stay. A
    character cut in two goes whole. A null text stays null, one that is
    repeated whole becomes empty; the rest is as in ``duplicates``. Columns of
    any name stay as they are.
    """
    names = docs.columns
    rows, extra = with_starts(docs, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = []
            for text, starts in zip(b.column("text").to_pylist(), b.column(extra).to_pylist(), strict=True):
                if starts:
                    raw = text.encode()
                    cuts = [(x, y) for x, y in spans(raw, starts, p) if len(raw[x:y].split()) >= p.words]
                    text = kept(raw, cuts).decode(errors="ignore") if cuts else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    out = in_arrow(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
