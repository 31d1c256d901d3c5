"""Near-duplicate detection by DartMinHash signatures and banded joining.

A document is a weighted set: its five-word shingles with their counts. Each
unit of weight is a cell into which hashed darts fall, a Poisson process along
a rank axis; a dart's hash names one of the signature's coordinates, and each
coordinate keeps its earliest dart. Two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity. Only about
``k ln k`` darts of a document are thrown, however long it is.

Equal weighted sets are merged first. Bands of coordinates then give buckets;
the members of a bucket are linked to its centre (the member that shares most
buckets with others), and each link is verified by the exact weighted Jaccard
similarity of the two whole texts. Members of a bucket that are in different
classes after that are compared pair by pair, in blocks, so that no pair that
shares a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import M2, M3, U64, cut, cut_counting, emit, fresh, in_arrow, limited, mix, salt, shingles, signed, small, strings, words
from rasterloom.llm.components import components


@dataclass(frozen=True)
class Params:
    width: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    #: Buckets of so many members at most are compared pair by pair; larger ones by centres.
    small: int = 4
    #: Further centres that are tried in buckets whose members aren't in one class yet.
    further: int = 2
    #: Members of a block, near enough, where what is left of a large bucket is compared pair by pair.
    block: int = 128
    #: Rows of a broadcast side at most (24 bytes each).
    broadcast_rows: int = 300_000


def cells(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of unit weight, as hashes, and their bounds by text: the n-th occurrence of a shingle is a cell of its own."""
    value, bounds = shingles(*words(texts), width)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key = mix(value + text.astype(U64) * M3)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(begin, np.diff(begin, append=len(key)))
    return mix(value + nth.astype(U64) * M2), bounds


def signatures(cell: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Signature (one row of ``k``) of each text that has cells; 0 elsewhere."""
    out = np.zeros((len(bounds) - 1, k), U64)
    weight = np.diff(bounds)
    todo, darts = np.flatnonzero(weight), k * (np.log(k) + 3.0)
    while len(todo):
        reach = darts / weight[todo]
        owner = np.repeat(np.arange(len(todo)), weight[todo])
        first = bounds[todo]
        at = cell[np.arange(len(owner)) - np.repeat(np.cumsum(weight[todo]) - weight[todo], weight[todo]) + np.repeat(first, weight[todo])]
        rank = np.zeros(len(at))
        found, n = [], 0
        while len(at):
            n += 1
            h = mix(at + salt(n))
            u = (h >> U64(11)).astype(float) * 2.0**-53
            hit = np.flatnonzero(u < -np.expm1(rank - reach[owner]))
            at, owner, h = at[hit], owner[hit], h[hit]
            rank = rank[hit] - np.log1p(-u[hit])
            found.append((owner, rank, mix(h ^ M2)))
        owner, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(rank)[::-1]  # the earliest dart is written last
        sig, full = np.zeros(len(todo) * k, U64), np.zeros(len(todo) * k, bool)
        place = owner * k + (dart % U64(k)).astype(np.int64)
        sig[place[order]] = dart[order]
        full[place] = True
        done = full.reshape(-1, k).all(1)
        out[todo[done]] = sig.reshape(-1, k)[done]
        todo, darts = todo[~done], darts * 2
    return out


ROWS = pa.schema([("doc_id", pa.int64()), ("rkey", pa.int64()), ("tkey", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    k = p.bands * p.rows
    for b in small(batches):
        cell, bounds = cells(strings(b.column("text")), p.width)
        some = np.diff(bounds) > 0
        key = np.zeros((len(some), 2), U64)
        if some.any():
            begin = bounds[:-1][some]
            key[some, 0], key[some, 1] = np.add.reduceat(mix(cell ^ M2), begin), np.add.reduceat(mix(cell ^ M3), begin)
        sig = signatures(cell, bounds, k).reshape(len(some), p.bands, p.rows)
        band = np.zeros((len(some), p.bands), U64)
        for r in range(p.rows):
            band = mix((band ^ sig[:, :, r]) * M3 + U64(r))
        band = signed(mix(band + np.arange(p.bands, dtype=U64) * M2))
        lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, p.bands, dtype=np.int32), pa.array(band.ravel()))
        raw = key.tobytes()
        keys = [raw[16 * i : 16 * i + 16] if ok else None for i, ok in enumerate(some)]
        yield from emit(ROWS, {**{c: b.column(c) for c in ("doc_id", "rkey", "tkey")}, "key": pa.array(keys, pa.binary()), "bands": lists})


def similarity(a: list[str], b: list[str], width: int) -> np.ndarray:
    """Exact weighted Jaccard similarity of the texts' shingle counts, pair by pair."""
    out = np.zeros(len(a))
    ca, ba = cells(a, width)
    cb, bb = cells(b, width)
    for i in range(len(a)):
        x, y = ca[ba[i] : ba[i + 1]], cb[bb[i] : bb[i + 1]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / max(1, len(x) + len(y) - both)
    return out


def row_keys(docs: DataFrame, rkey: str = "rkey", tkey: str = "tkey") -> DataFrame:
    """Adds two keys, which together name a row by its doc_id and text."""
    return docs.withColumns({rkey: F.xxhash64("doc_id", "text"), tkey: F.xxhash64(F.lit(7), "text", "doc_id")})


def _verified(pairs: DataFrame, n: int, docs: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """Those of the ``n`` pairs (a, b) whose texts are similar, and how many they are."""
    text = _texts(pairs.select(F.explode(F.array("a", "b")).alias("key")), 2 * n, docs, sets, p)  # a repeated row repeats its links, no more
    side = lambda c: text.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(small(batches, "text_a"), "text_b"):
            found = similarity(strings(batch.column("text_a")), strings(batch.column("text_b")), p.width)
            pick = pa.array(np.flatnonzero(found >= p.similarity - 1e-12))
            yield from emit(out, {"a": batch.column("a").take(pick), "b": batch.column("b").take(pick)})

    return cut_counting(in_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), check, "a binary, b binary"), rows=n, each=2000)


def _texts(keys: DataFrame, most: int | None, docs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """key, text of the sets named in ``keys`` (``most`` at most, if known); a repeated row gives its text again."""
    ends, n = cut_counting(keys.distinct().join(sets.select("key", "rkey", "tkey"), "key"), rows=most)
    return cut(row_keys(docs.select("doc_id", "text")).join(limited(ends, n, p.broadcast_rows), ["rkey", "tkey"]).select("key", "text"))


def similar_pairs(cell: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, least: float) -> np.ndarray:
    """Those pairs of texts that ``wanted`` (a square matrix) marks and whose exact weighted Jaccard similarity is ``least`` or more."""
    n, weight = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(n), weight)
    order = np.argsort(cell, kind="stable")
    new = np.ones(len(cell), bool)
    new[1:] = cell[order][1:] != cell[order][:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1)[column] > 1  # a cell of one text is in no intersection
    row, column = owner[order][often], column[often]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for k in range(len(edges) - 1):
        part = np.zeros((n, step), np.float32)
        part[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * step] = 1
        both += part @ part.T
    found = both / np.maximum(1, weight[:, None] + weight[None, :] - both.astype(float))
    return np.argwhere(wanted & (found >= least - 1e-12))


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _block(table: pa.Table, p: Params) -> pa.Table:
    """Links between members of two blocks (or within one) of a bucket that are in different classes; one for each two classes that it joins, at most."""
    key, label = table.column("key").to_pylist(), table.column("label").to_pylist()
    number: dict = {}
    group = np.array([number.setdefault(x, len(number)) for x in label])
    own, bucket = table.column("own").to_numpy(), table.column("bucket")[0].as_py()
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    wanted = np.triu(group[:, None] != group[None, :])
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        wanted &= own[:, None] != own[None, :]
    for t in range(p.bands):  # a pair is compared in the first bucket that it shares
        mine = bands[:, t] == bucket
        if mine.all():
            break
        wanted &= bands[:, t][:, None] != bands[:, t][None, :]
    need = np.flatnonzero(wanted.any(0) | wanted.any(1))
    out: list = []
    if len(need):
        parts = [cells(strings(b.column("text")), p.width) for b in small(table.take(pa.array(need)).combine_chunks().to_batches())]
        weight = np.concatenate([np.diff(b) for _, b in parts])
        bounds = np.concatenate([[0], np.cumsum(weight)])
        to = list(range(len(number)))

        def root(x: int) -> int:
            while to[x] != x:
                to[x] = to[to[x]]
                x = to[x]
            return x

        for x, y in need[similar_pairs(np.concatenate([c for c, _ in parts]), bounds, wanted[np.ix_(need, need)], p.similarity)]:
            a, b = root(group[x]), root(group[y])
            if a != b:
                to[a] = b
                out.append((min(key[x], key[y]), max(key[x], key[y])))
    return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=LINKS)


def _rest(marked: DataFrame, most: int, docs: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """Links between members of a large bucket (bucket, key, label; ``most`` rows at most) that are in different classes, and how many they are.

    The members outside a bucket's largest class are dealt into blocks, and so
    are those in it; each block of the former meets every block of both.
    """
    per = marked.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = per.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("n")).where(F.col("n") > F.col("top"))
    blocks = lambda n: F.ceil(n / F.lit(p.block)).cast("long")
    open_, n = cut_counting(open_.select("bucket", "most", blocks(F.col("n") - F.col("top")).alias("others"), blocks(F.col("top")).alias("mosts")), rows=most)
    if not n:
        return open_, 0
    deal = lambda n: F.pmod(F.xxhash64("key", "bucket"), F.col(n))
    rows = marked.join(limited(open_, n, p.broadcast_rows), "bucket")
    rows = rows.withColumn("own", F.when(F.col("label") == F.col("most"), -1 - deal("mosts")).otherwise(deal("others")))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    own = F.col("own")
    inner = F.concat(each("others", lambda x: pair(F.least(own, x), F.greatest(own, x))), each("mosts", lambda x: pair(-1 - x, own)))
    at = F.when(own < 0, each("others", lambda x: pair(own, x))).otherwise(inner)
    rows = cut(rows.select("bucket", "key", "label", "own", F.explode(at).alias("at")).select("bucket", "key", "label", "own", "at.*"))
    text = _texts(rows.select("key"), most, docs, sets, p).join(sets.select("key", "bands"), "key")
    return cut_counting(rows.join(text, "key").groupBy("bucket", "i", "j").applyInArrow(lambda t: _block(t, p), "a binary, b binary"))


def _joined(labels: DataFrame, nodes: int, new: DataFrame, n: int) -> DataFrame:
    """``labels``, of ``nodes`` sets at most, once the ``n`` links ``new`` are added: the classes that they join are components of the classes."""
    ends = new.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("node"), "e.b")
    side = ends.join(labels, "node", "left").select("node", "b", F.coalesce("label", "node").alias("la"))
    side = side.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").select(F.col("la").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(side.where(F.col("a") != F.col("b")), 2 * n).select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = labels.union(joined.select(F.col("label").alias("node"), "label")).distinct()
    return cut(every.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), nodes)


def classes(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, int, DataFrame]:
    """(rows, n, labels): each row's rkey, tkey, doc_id and set key, how many rows there are, and each set key's class."""
    rows, count = cut_counting(in_arrow(row_keys(docs.select("doc_id", "text")), lambda it: _sketch(it, p), "doc_id long, rkey long, tkey long, key binary, bands array<long>"))
    sets, total = cut_counting(rows.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "rkey", "tkey")).alias("least"), F.first("bands").alias("bands")).select("key", F.col("least.*"), "bands"), rows=count)
    held = sets.select("key", F.explode("bands").alias("bucket"))
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    hits, most = cut_counting(held.join(sizes, "bucket"), rows=total * p.bands)
    weight = hits.groupBy("key").agg(F.sum(F.ln("n")).alias("centrality"))
    hits = cut(hits.join(weight, "key"), most)
    low, high = F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")
    large, few = hits.where(F.col("n") > p.small), hits.where(F.col("n") <= p.small)
    centres, n = cut_counting(large.groupBy("bucket").agg(F.max_by("key", F.struct(F.round("centrality", 6), "key")).alias("centre")), rows=most)
    star = large.join(limited(centres, n, p.broadcast_rows), "bucket").where(F.col("key") != F.col("centre")).select(low, high)
    close = few.select("bucket", F.col("key").alias("a")).join(few.select("bucket", F.col("key").alias("b")), "bucket").where(F.col("a") < F.col("b")).select("a", "b")
    tried, n = cut_counting(star.union(close).distinct(), rows=most * max(1, p.small // 2))
    links, n = _verified(tried, n, docs, sets, p)
    labels = components(links, n)
    # Buckets that still hold several classes try further centres on the members of other classes than the centre's.
    marked = cut(hits.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), most)
    drawn = F.array(*[F.max_by(F.struct("key", "label"), F.xxhash64(F.lit(turn), "key", "bucket")) for turn in range(p.further)])
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), drawn.alias("c")).where(F.col("low") != F.col("high"))
    open_, n = cut_counting(open_.select("bucket", F.explode(F.array_distinct("c")).alias("c")).select("bucket", F.col("c.key").alias("centre"), F.col("c.label").alias("other")), rows=most * p.further)
    more = marked.join(limited(open_, n, p.broadcast_rows), "bucket").where(F.col("label") != F.col("other")).select(low, high)
    more, n = cut_counting(more.distinct().join(tried, ["a", "b"], "left_anti"), rows=most * p.further)
    new, n = _verified(more, n, docs, sets, p) if n else (more, 0)
    if n:
        labels = _joined(labels, total, new, n)
    # What is still in different classes in a large bucket is compared pair by pair.
    marked = cut(large.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), most)
    last, n = _rest(marked, most, docs, sets, p)
    if n:
        labels = _joined(labels, total, last, n)
    named = sets.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.drop("bands"), count, cut(named.join(least, "label").select("key", "class_id", "label"), total)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, class_id, in_group: the class of each row (columns doc_id and text; others are ignored).

    class_id is the smallest doc_id of the class. A text of one to four words
    has one shingle of all its words; a text without a word (null too) is
    alone in its class. Repeated rows fall into one class. in_group says
    whether other texts, or copies, are in the class. An empty table gives an
    empty result.
    """
    rows, _, labels = classes(docs, p)
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    size = labels.join(size, "key").groupBy("label").agg(F.sum("n").alias("n"))
    known = labels.join(size, "label").select("key", "class_id", (F.col("n") > 1).alias("in_group"))
    return rows.join(known, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("in_group", F.lit(False)).alias("in_group"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows of ``docs``, all columns, without those whose class has an earlier row (by doc_id, then by key).

    A row with a null doc_id comes first. Texts without a word (null and empty
    too) are alone in their class and stay. Of rows repeated with doc_id and
    text one stays. A text of any length is compared whole; an empty table gives
    an empty result. Columns of any name stay as they are.
    """
    rows, count, labels = classes(docs, p)
    named = rows.where("key is not null").join(labels.select("key", "label"), "key")
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "rkey", "tkey")).alias("first"), F.count("*").alias("n")).where("n > 1").select("label", "first")
    first, n = cut_counting(first, rows=count)
    dropped = named.join(limited(first, n, p.broadcast_rows), "label").where(F.struct("doc_id", "rkey", "tkey") != F.col("first")).select("rkey", "tkey").distinct()
    dropped, n = cut_counting(dropped, rows=count)
    names = [fresh(docs.columns, "rkey"), fresh(docs.columns, "tkey")]
    out = row_keys(docs, *names).join(limited(dropped.toDF(*names), n, p.broadcast_rows), names, "left_anti")
    again, n = cut_counting(rows.where("key is not null").groupBy("rkey", "tkey").agg(F.count("*").alias("n")).where("n > 1").select("rkey", "tkey").join(dropped, ["rkey", "tkey"], "left_anti"), rows=count)
    if n:  # rows repeated with doc_id and text: one of each stays
        again = again.toDF(*names)
        once = out.join(again, names, "left_semi").dropDuplicates(names)
        out = out.join(again, names, "left_anti").unionByName(once)
    return out.select(*docs.columns)
