"""Exact top-k inner-product search by a Voronoi kNN join.

Vectors are lifted by one coordinate, so that the order by inner product is the
order by Euclidean distance: data get sqrt(m - |x|^2), queries get 0. Pivots,
as many as the square root of the rows, cut the space into cells. Summaries of
the cells (the k + 1 smallest distances to the pivot) bound the distance within
which each query finds its k neighbours. A group of queries needs of a cell
only data rows that can lie within the bound of one of its queries, by the
triangle inequality over the cell's pivot and by the plane halfway between the
query's own pivot and that one; only those are sent to the group. Groups and
the data sent to them meet in blocks of bounded size, solved by matrix
products; the blocks' short lists are merged at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import U64, cut, emit, in_arrow, mix


@dataclass(frozen=True)
class Params:
    k: int = 5
    every: int = 50
    scale: int = 256
    #: Pivots: the square root of the rows, within these bounds; they only decide how much is sent.
    pivots: tuple[int, int] = (32, 1024)
    #: Queries of a group and data rows of a block, near enough.
    group_rows: int = 4096
    block_rows: int = 32_768


PACKED = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("norm", pa.float64()), ("is_query", pa.bool_())])
PACKED_DDL = "rid long, vec_id long, v binary, norm double, is_query boolean"


def _pack(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with integer components as bytes."""
    for b in batches:
        lists = b.column("embedding")
        flat = lists.flatten().cast(pa.float64())
        x = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        fine = (bad[ends[1:]] == bad[ends[:-1]]) & pc.and_(b.column("vec_id").is_valid(), lists.is_valid()).to_numpy(zero_copy_only=False)
        whole = np.floor(p.scale * np.where(np.isfinite(x), x, 0.0))
        squares = np.concatenate([[0.0], np.cumsum(whole * whole)])
        norm = squares[ends[1:]] - squares[ends[:-1]]
        raw = whole.astype("<i8").tobytes()
        pick = np.flatnonzero(fine)
        at = pa.array(pick)
        yield from emit(PACKED, {"rid": b.column("rid").take(at), "vec_id": b.column("vec_id").take(at), "v": [raw[8 * ends[i] : 8 * ends[i + 1]] for i in pick], "norm": norm[pick], "is_query": b.column("is_query").take(at)})


def matrix(values, width: int) -> np.ndarray:
    """Packed vectors as rows, short ones filled with zeros."""
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), "<i8").astype(np.int64).reshape(len(values), width)
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        row = np.frombuffer(v, "<i8")
        out[i, : len(row)] = row
    return out


def _lifted(m: np.ndarray, norm: np.ndarray, most: float, query: np.ndarray) -> np.ndarray:
    extra = np.where(query, 0.0, np.sqrt(np.maximum(0.0, most - norm)))
    return np.hstack([m.astype(float), extra[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * (x @ pivots.T)))


def _best(q: np.ndarray, q_rid, q_id, d: np.ndarray, d_rid, d_id, k: int) -> pd.DataFrame:
    """The k best data rows for each query, ties to the smaller id."""
    peak = int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * q.shape[1]
    order = np.lexsort((d_rid, d_id))  # a stable sort by score then keeps the smaller id first
    d, d_rid, d_id = d[order], d_rid[order], d_id[order]
    out = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        score = (part.astype(float) @ d.T.astype(float)).astype(np.int64) if peak < 2**52 else part @ d.T if peak < 2**62 else (part.astype(object) @ d.T.astype(object))
        own = q_rid[at : at + 256, None] == d_rid[None, :]
        for i in range(len(part)):
            s, ok = score[i], np.flatnonzero(~own[i])
            if len(ok) > 4 * k and s.dtype != object:
                kth = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                ok = ok[s[ok] >= kth]
            for j in ok[np.argsort(-s[ok], kind="stable")[:k]]:
                out.append((q_rid[at + i], q_id[at + i], d_rid[j], d_id[j], int(s[j])))
    return pd.DataFrame(out, columns=["q_rid", "query_id", "d_rid", "vec_id", "score"])


CELLS = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("as_query", pa.bool_()), ("cell", pa.int32()), ("dist", pa.float64())])
CELLS_DDL = "rid long, vec_id long, v binary, as_query boolean, cell int, dist double"
SENT = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("as_query", pa.bool_()), ("g", pa.int64()), ("b", pa.int64())])
SENT_DDL = "rid long, vec_id long, v binary, as_query boolean, g long, b long"
BOUNDS = pa.schema([("g", pa.int64()), ("least", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Cells:
    """What every task knows of the pivots and of the groups of queries."""

    centre: np.ndarray
    between: np.ndarray
    near: np.ndarray  # the k + 1 smallest distances to each pivot, inf where there are fewer
    first: np.ndarray  # first group of the queries in each cell
    parts: np.ndarray  # and how many groups they are dealt over
    width: int
    most: float
    blocks: int
    slack: float

    def group(self, cell: np.ndarray, rid: np.ndarray) -> np.ndarray:
        return self.first[cell] + (mix(rid.astype(U64)) % self.parts[cell].astype(U64)).astype(np.int64)

    def least(self, q: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
        """For each query (lifted) and each cell, the distance to the cell's pivot from which data can be among its best (inf if none can)."""
        to = _distances(q, self.centre)
        upper = (to[:, :, None] + self.near[None]).reshape(len(q), -1)
        reach = (np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k else np.full(len(q), np.inf)) + self.slack  # one may be the query itself
        low = to - reach[:, None] - self.slack
        apart = self.between[cell]
        own = to[np.arange(len(q)), cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            halfway = np.where(apart > self.slack, (to * to - (own * own)[:, None]) / (2 * apart), 0.0)
        return np.where(halfway > reach[:, None] + self.slack, np.inf, low)


def _grouped(asked: list, between: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group and number of groups of each cell's queries: near cells form a group of about ``rows`` queries, a larger cell is dealt over several."""
    n = {r.cell: r.n for r in asked}
    first, parts, groups = np.zeros(len(between), np.int64), np.ones(len(between), np.int64), 0
    free = sorted(n, key=lambda i: -n[i])
    while free:
        i, total, members = free[0], 0, []
        for j in sorted(free, key=lambda j: (j != i, between[i, j])):
            if members and total + n[j] > rows:
                break
            members.append(j)
            total += n[j]
        first[members], parts[members] = groups, -(-total // rows)
        groups += int(parts[i])
        taken = set(members)
        free = [j for j in free if j not in taken]
    return first, parts, groups


def sent_rows(vectors: DataFrame, p: Params = Params()) -> tuple[DataFrame, int, int]:
    """(rows as they are sent to groups ``g`` and blocks ``b``, components of a vector, groups)."""
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding", (F.col("vec_id") % p.every == 0).alias("is_query"))
    packed = cut(in_arrow(rows, lambda it: _pack(it, p), PACKED_DDL))
    known = packed.agg(F.max(F.length("v")).alias("bytes"), F.max("norm").alias("most"), F.count("*").alias("n")).first()
    width, most = (known["bytes"] or 0) // 8, known["most"] or 0.0
    pivots = min(max(math.isqrt(known["n"]), p.pivots[0]), p.pivots[1])
    chosen = [r.v for r in packed.orderBy(F.xxhash64("vec_id", "v"), "rid").limit(pivots).select("v").collect()] or [b""]
    centre = matrix(chosen, width)
    centre = _lifted(centre, (centre.astype(float) ** 2).sum(1), most, np.zeros(len(centre), bool))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nearest pivot and distance of each row as data, and of each query as a query."""
        for b in it:
            m, norm, query = matrix(b.column("v").to_pylist(), width), b.column("norm").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            for as_query in (False, True):
                for pick in np.array_split(np.flatnonzero(query) if as_query else np.arange(len(m)), 1 + len(m) // 1024):
                    d = _distances(_lifted(m[pick], norm[pick], most, np.full(len(pick), as_query)), centre)
                    cell, at = d.argmin(1), pa.array(pick)
                    yield from emit(CELLS, {**{c: b.column(c).take(at) for c in ("rid", "vec_id", "v")}, "as_query": np.full(len(pick), as_query), "cell": cell.astype(np.int32), "dist": d[np.arange(len(pick)), cell]})

    cells = cut(in_arrow(packed, assign, CELLS_DDL))
    near = in_arrow(cells.where("not as_query").select("cell", "dist"), lambda it: _nearest(it, p.k + 1), "cell int, near array<double>")
    close = np.full((len(centre), p.k + 1), np.inf)
    for r in near.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, p.k + 1).alias("near")).collect():
        close[r.cell, : len(r.near)] = r.near
    between = _distances(centre, centre)
    first, parts, groups = _grouped(cells.where("as_query").groupBy("cell").agg(F.count("*").alias("n")).collect(), between, p.group_rows)
    know = Cells(centre, between, close, first, parts, width, most, max(1, -(-known["n"] // p.block_rows)), 1e-6 * (1.0 + math.sqrt(most)))
    shared = vectors.sparkSession.sparkContext.broadcast(know)

    def bounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group, the least of its queries' bounds."""
        c, least = shared.value, {}
        for b in it:
            m, cell, rid = matrix(b.column("v").to_pylist(), c.width), b.column("cell").to_numpy(), b.column("rid").to_numpy()
            for pick in np.array_split(np.arange(len(m)), 1 + len(m) // 256):
                if len(pick):
                    low, group = c.least(_lifted(m[pick], np.zeros(len(pick)), c.most, np.ones(len(pick), bool)), cell[pick], p.k), c.group(cell[pick], rid[pick])
                    for g in np.unique(group):
                        least[g] = np.minimum(low[group == g].min(0), least.get(g, np.inf))
        yield from emit(BOUNDS, {"g": list(least), "least": [x.tolist() for x in least.values()]})

    found = in_arrow(cells.where("as_query").select("rid", "v", "cell"), bounds, "g long, least array<double>").select("g", F.posexplode("least").alias("cell", "least"))
    found = found.groupBy("g", "cell").agg(F.min("least").alias("least")).where(F.col("least") < math.inf).collect()
    least = np.full((groups, len(centre)), np.inf)
    for r in found:
        least[r.g, r.cell] = r.least
    needed = vectors.sparkSession.sparkContext.broadcast(least)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries go to every block of their group; data to one block of each group that can need them."""
        c = shared.value
        for b in it:
            rid = b.column("rid").to_numpy()
            as_query, cell, dist = b.column("as_query").to_numpy(zero_copy_only=False).astype(bool), b.column("cell").to_numpy(), b.column("dist").to_numpy()
            block = (mix(rid.astype(U64) + U64(977)) % U64(c.blocks)).astype(np.int64)
            q = np.flatnonzero(as_query)
            group = c.group(cell[q], rid[q])
            deals = [(q, group, np.full(len(q), n)) for n in range(c.blocks)]
            for g, bound in enumerate(needed.value):
                d = np.flatnonzero(~as_query & (dist >= bound[cell]))
                deals.append((d, np.full(len(d), g), block[d]))
            for at, to_group, to_block in deals:
                pick = pa.array(at)
                yield from emit(SENT, {**{x: b.column(x).take(pick) for x in ("rid", "vec_id", "v", "as_query")}, "g": to_group, "b": to_block})

    return in_arrow(cells, send, SENT_DDL), width, groups


def top_k(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but the query's own. Rows with a null vec_id, a null vector or a null
    or non-finite component take no part; a vector shorter than another counts
    as filled with zeros. Ties go to the smaller vec_id. Repeated rows are
    candidates each on its own, and each is a query if its id is. Fewer
    candidates than ``k`` give fewer rows; no query, or an empty table, gives
    an empty result. Extra columns are ignored. The driver gets the pivots,
    k + 1 numbers for each, and one bound for each pivot that a group of
    ``group_rows`` queries can need.
    """
    sent, width, _ = sent_rows(vectors, p)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf.as_query], pdf[~pdf.as_query]
        return _best(matrix(q.v.tolist(), width), q.rid.to_numpy(), q.vec_id.to_numpy(), matrix(d.v.tolist(), width), d.rid.to_numpy(), d.vec_id.to_numpy(), p.k)

    short = sent.groupBy("g", "b").applyInPandas(solve, "q_rid long, query_id long, d_rid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "d_rid"))
    return short.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _nearest(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best: dict[int, np.ndarray] = {}
    for b in it:
        cell, dist = b.column("cell").to_numpy(), b.column("dist").to_numpy()
        for c in np.unique(cell):
            best[int(c)] = np.sort(np.concatenate([best.get(int(c), dist[:0]), dist[cell == c]]))[:k]
    yield from emit(pa.schema([("cell", pa.int32()), ("near", pa.list_(pa.float64()))]), {"cell": list(best), "near": [x.tolist() for x in best.values()]})
