"""Persistence diagrams: weighting, selection, scaling and vectorisation.

A diagram table has the given key columns and birth, death (death > birth after
``oriented``). Sampled representations use a grid over the collection's range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(diagram: DataFrame, weight: str) -> DataFrame:
    """image_id, gem, birth, death of a superlevel diagram as weight * (life_death, life_birth), so that birth < death."""
    return diagram.select("image_id", "gem", (F.col(weight) * F.col("life_death")).alias("birth"), (F.col(weight) * F.col("life_birth")).alias("death"))


def without_first(diagram: DataFrame) -> DataFrame:
    """Without each image's first component in birth order."""
    return diagram.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("gem"))).where("place > 1").drop("place")


def finite(diagram: DataFrame) -> DataFrame:
    """Points that die, and have a length."""
    return diagram.where((F.col("death") < float("inf")) & (F.col("death") > F.col("birth")))


def min_max(diagram: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Both coordinates scaled to 0..1 over the (fitted) collection's range of each."""
    source = fitted if fitted is not None else diagram
    ends = source.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("birth", "death") for n, f in (("low", F.min), ("high", F.max))]).alias("ends")).scalar()
    return diagram.withColumns({c: F.coalesce(F.try_divide(F.col(c) - ends[f"low_{c}"], ends[f"high_{c}"] - ends[f"low_{c}"]), F.lit(0.0)) for c in ("birth", "death")})


def scaled_by_amplitude(diagram: DataFrame, *keys: str) -> DataFrame:
    """Divided by the collection's largest bottleneck amplitude (half the longest life), for each combination of ``keys``."""
    most = F.max((F.col("death") - F.col("birth")) / 2)
    if not keys:
        most_all = diagram.agg(most).scalar()
        return diagram.withColumns({c: F.col(c) / F.nullif(most_all, F.lit(0.0)) for c in ("birth", "death")})
    top = diagram.groupBy(*keys).agg(most.alias("top"))
    return diagram.join(top, list(keys)).withColumns({c: F.col(c) / F.nullif(F.col("top"), F.lit(0.0)) for c in ("birth", "death")}).drop("top")


def summaries(diagram: DataFrame, *keys: str, p: float = 2.0) -> DataFrame:
    """points, entropy, normalized_entropy, bottleneck, wasserstein for each combination of ``keys``.

    Entropy is -sum(l/S log2(l/S)) over lives l of sum S; normalised, divided
    by log2 S; -1 where that is undefined. Amplitudes are distances to the
    empty diagram.
    """
    life = F.col("death") - F.col("birth")
    total = F.col("s")
    entropy = F.when(total > 0, F.log2(total) - F.col("sl") / total)
    sums = diagram.where(life > 0).groupBy(*keys).agg(
        F.count("*").alias("points"), F.sum(life).alias("s"), F.sum(life * F.log2(life)).alias("sl"), (F.max(life) / 2).alias("bottleneck"), F.pow(F.sum(F.pow(life / 2, F.lit(p))), F.lit(1 / p)).alias("wasserstein")
    )
    return sums.select(*keys, "points", F.coalesce(entropy, F.lit(-1.0)).alias("entropy"), F.coalesce(F.try_divide(entropy, F.log2(total)), F.lit(-1.0)).alias("normalized_entropy"), "bottleneck", "wasserstein")


def grid(diagram: DataFrame, m: int) -> tuple[Column, Column]:
    """Start and step of a grid of ``m`` points over the collection's births and deaths."""
    ends = diagram.agg(F.struct(F.min("birth").alias("low"), F.max("death").alias("high")).alias("ends")).scalar()
    return ends["low"], (ends["high"] - ends["low"]) / F.lit(m - 1)


def sampled(diagram: DataFrame, *keys: str, m: int = 100) -> DataFrame:
    """keys, i, x, betti, landscape, silhouette at each grid point that some point of the diagram covers.

    Betti: how many points have birth <= x < death. Landscape: the largest
    tent min(x - birth, death - x). Silhouette: the mean tent, weighted by life.
    A point is spread over the grid places inside its life only.
    """
    low, step = grid(diagram, m)
    b, d, x = F.col("birth"), F.col("death"), F.col("x")
    first, last = F.ceil((b - low) / step - 1e-9).cast("int"), F.floor((d - low) / step + 1e-9).cast("int")
    spread = diagram.where(d > b).withColumns({"first": F.greatest(first, F.lit(0)), "last": F.least(last, F.lit(m - 1)), "low": low, "step": step, "life": d - b})
    whole = Window.partitionBy(*keys)
    spread = spread.withColumn("weight", F.sum("life").over(whole)).where("first <= last").select(*keys, "birth", "death", "life", "weight", "low", "step", F.explode(F.sequence("first", "last")).alias("i"))
    spread = spread.withColumn("x", F.col("low") + F.col("i") * F.col("step"))
    tent = F.greatest(F.least(x - b, d - x), F.lit(0.0))
    return spread.groupBy(*keys, "i", "x").agg(F.count_if((b <= x) & (x < d)).alias("betti"), F.max(tent).alias("landscape"), (F.sum(F.col("life") * tent) / F.first("weight")).alias("silhouette"))


def sampled_amplitudes(diagram: DataFrame, *keys: str, m: int = 100, p: float = 2.0) -> DataFrame:
    """keys, betti, landscape, silhouette: L^p norms over the grid."""
    _, step = grid(diagram, m)
    norm = lambda c: F.pow(step * F.sum(F.pow(F.abs(F.col(c)).cast("double"), F.lit(p))), F.lit(1 / p)).alias(c)
    return sampled(diagram, *keys, m=m).groupBy(*keys).agg(norm("betti"), norm("landscape"), norm("silhouette"))


def landscape_layers(diagram: DataFrame, *keys: str, layers: int = 2, m: int = 100) -> DataFrame:
    """keys, i, layer, value: the ``layers`` largest tents at each grid point."""
    low, step = grid(diagram, m)
    x = F.col("low") + F.col("i") * F.col("step")
    rows = diagram.where("death > birth").withColumns({"low": low, "step": step}).select(*keys, "birth", "death", "low", "step", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    rows = rows.withColumn("value", F.least(x - F.col("birth"), F.col("death") - x)).where("value > 0")
    layer = F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.desc("value")))
    return rows.withColumn("layer", layer).where(F.col("layer") <= layers).select(*keys, "i", "layer", "value")


def gaussian_images(diagram: DataFrame, *keys: str, m: int = 20, sigma: float = 0.1) -> DataFrame:
    """keys, heat, persistence_image: L2 norms of the two Gaussian rasters over an m x m grid.

    Heat: a Gaussian at (birth, death) less its mirror image. Persistence
    image: Gaussians at (birth, life) weighted by life. sigma is in units of
    the grid's range. A diagram is one array row, so nothing but the gathering
    of its points is shuffled.
    """
    ends = diagram.agg(F.struct(F.min("birth").alias("low"), F.max("death").alias("high")).alias("ends")).scalar()
    low, high = ends["low"], ends["high"]
    points = F.collect_list(F.struct("birth", "death"))
    rows = diagram.where("death > birth").groupBy(*keys).agg(points["birth"].alias("births"), points["death"].alias("deaths")).withColumns({"low": low, "high": high})
    schema = ", ".join(f"{k} {t}" for k, t in diagram.dtypes if k in keys) + ", heat double, persistence_image double"

    def norms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            heat, image = [], []
            for births, deaths, lo, hi in zip(pdf.births, pdf.deaths, pdf.low, pdf.high, strict=True):
                x, y, s = np.linspace(lo, hi, m), np.linspace(0, hi - lo, m), sigma * (hi - lo)
                bump = lambda at, x=x, s=s: np.exp(-((x[None, :] - at[:, None]) ** 2) / (2 * s * s)) / (math.sqrt(2 * math.pi) * s)
                gb, gd, life = bump(births), bump(deaths), deaths - births
                step = x[1] - x[0]
                heat.append(step * np.linalg.norm(gb.T @ gd - gd.T @ gb))
                image.append(step * np.linalg.norm((gb * life[:, None]).T @ bump(life, y)))
            yield pdf[list(keys)].assign(heat=heat, persistence_image=image)

    return rows.mapInPandas(norms, schema)


def persistence_images(diagram: DataFrame, *keys: str, m: int = 20, sigma: float = 0.1) -> DataFrame:
    """keys, place, value: the persistence image itself, row-major over (life, birth), of the cells that aren't 0.

    Gaussians at (birth, life) weighted by life, as in ``gaussian_images``;
    its L2 norm times the grid's step is the amplitude there.
    """
    ends = diagram.agg(F.struct(F.min("birth").alias("low"), F.max("death").alias("high")).alias("ends")).scalar()
    rows = diagram.where("death > birth").withColumns({"low": ends["low"], "high": ends["high"]}).withColumn("life", F.col("death") - F.col("birth"))
    width = F.col("high") - F.col("low")
    bump = lambda at, x: F.exp(-F.pow(x - at, F.lit(2.0)) / (2 * F.pow(sigma * width, F.lit(2.0)))) / (math.sqrt(2 * math.pi) * sigma * width)
    cells = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))))
    across, up = F.col("low") + (F.col("place") % m) * width / (m - 1), F.floor(F.col("place") / m) * width / (m - 1)
    return cells.groupBy(*keys, "place").agg(F.sum(F.col("life") * bump(F.col("birth"), across) * bump(F.col("life"), up)).alias("value")).where("value > 0")


# -- distances to a query set of diagrams


def as_arrays(diagram: DataFrame) -> DataFrame:
    """One row for each image: points as sorted arrays of [birth, death]."""
    return diagram.groupBy("image_id").agg(F.array_sort(F.collect_list(F.array("birth", "death"))).alias("points"))


def sliced_wasserstein(a: np.ndarray, b: np.ndarray, directions: int = 20) -> float:
    """Mean over directions of the transport between projections, each diagram filled up with the other's diagonal points."""
    theta = -np.pi / 2 + np.pi * np.arange(directions) / directions
    u = np.stack([np.cos(theta), np.sin(theta)])
    flat = lambda x: np.repeat(x.mean(1, keepdims=True), 2, 1)
    left, right = np.vstack([a, flat(b)]) @ u, np.vstack([b, flat(a)]) @ u
    return float(np.abs(np.sort(left, 0) - np.sort(right, 0)).sum(0).mean())


def bottleneck(a: np.ndarray, b: np.ndarray, epsilon: float = 0.0) -> float:
    """Bottleneck distance: the least radius at which a perfect matching exists, up to ``epsilon``."""
    n, m = len(a), len(b)
    if not n and not m:
        return 0.0
    half = lambda x: (x[:, 1] - x[:, 0]) / 2
    cost = np.full((n + m, n + m), np.inf)
    cost[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(2) if n and m else cost[:n, :m]
    cost[np.arange(n), m + np.arange(n)] = half(a) if n else cost[np.arange(n), m + np.arange(n)]
    cost[n + np.arange(m), np.arange(m)] = half(b) if m else cost[n + np.arange(m), np.arange(m)]
    cost[n:, m:] = 0
    radii = np.unique(cost[np.isfinite(cost)])
    lo, hi = 0, len(radii) - 1
    while lo < hi and radii[hi] - radii[lo] > epsilon:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _matches(cost <= radii[mid]) else (mid + 1, hi)
    return float(radii[hi])


def _matches(ok: np.ndarray) -> bool:
    """Whether a perfect matching exists (augmenting paths)."""
    mate = [-1] * len(ok)
    edges = [np.flatnonzero(r).tolist() for r in ok]

    def augment(u: int, seen: set[int]) -> bool:
        for v in edges[u]:
            if v not in seen:
                seen.add(v)
                if mate[v] < 0 or augment(mate[v], seen):
                    mate[v] = u
                    return True
        return False

    return all(augment(u, set()) for u in range(len(ok)))


def saturated(edges: list[list[int]]) -> bool:
    """Whether each row finds a column of its own among its edges (augmenting paths, breadth first)."""
    row_of: dict[int, int] = {}
    column_of: dict[int, int] = {}
    for u in range(len(edges)):
        came: dict[int, int] = {}
        queue, end = [u], None
        for x in queue:  # grows meanwhile
            for v in edges[x]:
                if v not in came:
                    came[v] = x
                    if v not in row_of:
                        end = v
                        break
                    queue.append(row_of[v])
            if end is not None:
                break
        if end is None:
            return False
        while end is not None:
            x = came[end]
            row_of[end], column_of[x], end = x, end, column_of.get(x)
    return True


def padded(points: list[np.ndarray], fill: float) -> np.ndarray:
    """Diagrams as one array (diagram, point, coordinate), filled up to the longest."""
    out = np.full((len(points), max(map(len, points)), 2), fill)
    for i, x in enumerate(points):
        out[i, : len(x)] = x
    return out


def by_size(left: list[np.ndarray], right: list[np.ndarray], f, cells, most: int) -> np.ndarray:
    """``f`` of tiles of both lists, in order of size so that little is filled up; a tile's pairs have about ``most`` cells."""
    out = np.empty((len(left), len(right)))
    rows, columns = (sorted(range(len(x)), key=lambda i, x=x: -len(x[i])) for x in (left, right))
    a = 0
    while a < len(rows):
        side = max(1, min(64, math.isqrt(most // max(1, cells(len(left[rows[a]]), len(right[columns[0]]))))))
        i = rows[a : a + side]
        for b in range(0, len(columns), side):
            j = columns[b : b + side]
            out[np.ix_(i, j)] = f([left[x] for x in i], [right[x] for x in j])
        a += side
    return out


def size_runs(points: list[np.ndarray], most: int, squared: bool = False) -> list[list[int]]:
    """Numbers of the diagrams in order of size, cut into runs of about ``most`` points (or, ``squared``, points times diagrams)."""
    found: list[list[int]] = []
    n = 0
    for i in sorted(range(len(points)), key=lambda i: len(points[i])):
        n += len(points[i])
        if not found or n * (len(found[-1]) + 1 if squared else 1) > most:
            found.append([])
            n = len(points[i])
        found[-1].append(i)
    return found


def level_ends(points: list[np.ndarray], u: np.ndarray) -> tuple[np.ndarray, ...]:
    """diagram, and by direction (u) and end: at, level, sign (1 where a set of the level begins, -1 where it ends), for diagrams in order of size.

    In one direction a diagram is a step function: how many points lie below a
    place, less how many of their places on the diagonal do. Its level set
    number k > 0 is where it is k at least, k <= 0 where it is less than k.
    """
    sizes = np.array([len(x) for x in points])
    parts = []
    for n in np.unique(sizes):
        x = np.array([p for p in points if len(p) == n], float).reshape(np.count_nonzero(sizes == n), n, 2)
        at = np.concatenate([x @ u, np.repeat(x.mean(2, keepdims=True), 2, 2) @ u], 1).transpose(2, 0, 1)
        order = at.argsort(2)
        step = np.where(order < n, 1.0, -1.0)
        count = step.cumsum(2)
        level = np.maximum(count, count - step)
        parts.append([y.reshape(u.shape[1], 2 * n * len(x)) for y in (np.take_along_axis(at, order, 2), level, np.where(level > 0, step, -step))])
    return np.repeat(np.arange(len(points)), 2 * sizes), *(np.concatenate(y, 1) for y in zip(*parts, strict=True))


def sliced_wasserstein_all(left: list[np.ndarray], right: list[np.ndarray], directions: int = 20) -> np.ndarray:
    """``sliced_wasserstein`` of each pair of two lists.

    In each direction it is the area between two step functions (``level_ends``):
    what their level sets measure, less twice what those of the same level
    share. A set's measure up to a place is a straight line between the ends of
    a block of the right side, so it is read from a table of these lines, and
    what is shared is a product of an own diagram's few ends and their lines.
    """
    theta = -np.pi / 2 + np.pi * np.arange(directions) / directions
    u = np.stack([np.cos(theta), np.sin(theta)])
    out = np.empty((len(left), len(right)))
    far = 4 * max((np.abs(x).max() for x in (*left, *right) if len(x)), default=0.0)  # puts levels one behind the other
    measure = lambda who, at, sign, n: -np.bincount(who, (sign * at).sum(0), n)
    across = np.flatnonzero(np.abs(u[0] - u[1]) > 1e-9)  # a point and its place on the diagonal are one in the diagonal's direction
    for i in size_runs(left, 16_000):
        own = [left[x] for x in i]
        who, at, level, sign = level_ends(own, u)
        key = level * far + at
        order = key.argsort(1)
        key = np.take_along_axis(key, order, 1)
        lines = np.stack([-sign, -sign * at], 2).reshape(directions, -1)
        size = np.array([len(x) for x in own])
        first, whole = np.cumsum(2 * size) - 2 * size, measure(who, at, sign, len(own))
        for j in size_runs(right, 26_000, squared=True):
            to, to_at, to_level, to_sign = level_ends([right[x] for x in j], u)
            shared = np.zeros((len(own), len(j)))
            groups = []
            for n in np.unique(size[size > 0]):
                a, last = np.searchsorted(size, (n, n + 1))
                side = max(1, 26_000 // (2 * n * len(j)))
                groups += [(slice(b, min(b + side, last)), n) for b in range(a, last, side)]
            for k in across:
                to_key = to_level[k] * far + to_at[k]
                o = to_key.argsort()
                table, step = np.zeros((len(o) + 1, 2, len(j))), to_sign[k][o]
                rows = np.arange(1, len(o) + 1)
                table[rows, 0, to[o]], table[rows, 1, to[o]] = -step * to_at[k][o], step
                np.cumsum(table, 0, out=table)
                line = np.empty(len(who), np.intp)
                line[order[k]] = np.repeat(np.arange(len(o) + 1), np.diff(np.searchsorted(key[k], to_key[o]), prepend=0, append=len(who)))
                for rows, n in groups:
                    b, m = first[rows.start], rows.stop - rows.start
                    found = table.take(line[b : b + 2 * n * m], 0).reshape(m, 4 * n, len(j))
                    shared[rows] += (lines[k, 2 * b : 2 * b + 4 * n * m].reshape(m, 1, 4 * n) @ found)[:, 0]
            out[np.ix_(i, j)] = np.maximum(whole[:, None] + measure(to, to_at, to_sign, len(j)) - 2 * shared, 0) / directions
    return out


def bottleneck_all(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``bottleneck`` of each pair of two lists, exactly.

    A radius is enough if the points of each side that are further than that
    from the diagonal can be matched into the other side: matchings that cover
    some points of one side, and some of the other, can be joined to one that
    covers both. No radius below each point's best choice is enough; mostly that
    one is, which a greedy matching shows for many pairs at once. The others
    are searched one by one.
    """
    half = lambda x: (x[:, :, 1] - x[:, :, 0]) / 2

    def enough(near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For each pair: does a greedy matching give each far row a column of its own?"""
        ok, free = np.ones(len(near), bool), np.ones((len(near), near.shape[2]), bool)
        near = near & far[:, :, None]
        wanted = near.sum(1)
        for k in range(near.shape[1]):
            open_ = near[:, k] & free
            pick = np.where(open_, wanted, near.shape[1] + 1).argmin(1)
            found = open_[np.arange(len(pick)), pick]
            ok &= found | ~far[:, k]
            free[np.flatnonzero(found), pick[found]] = False
        return ok

    def searched(cost: np.ndarray, own: np.ndarray, other: np.ndarray, least: float) -> float:
        radii = np.unique(np.concatenate([cost.ravel(), own, other]))
        radii = radii[(radii >= least) & np.isfinite(radii)]
        lo, hi = 0, len(radii) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            near = cost <= radii[mid]
            both = ((near, own), (near.T, other))
            if all(saturated([np.flatnonzero(r).tolist() for r in x[y > radii[mid]]]) for x, y in both):
                hi = mid
            else:
                lo = mid + 1
        return float(radii[hi])

    def tile(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        x, y = padded(a, np.inf), padded(b, -np.inf)
        n, m = x.shape[1], y.shape[1]
        own, other = half(padded(a, 0.0)), half(padded(b, 0.0))
        cost = np.abs(x[:, None, :, None, 0] - y[None, :, None, :, 0])
        np.maximum(cost, np.abs(x[:, None, :, None, 1] - y[None, :, None, :, 1]), out=cost)
        least = np.zeros((len(a), len(b)))
        for sides in (np.minimum(own[:, None], cost.min(3, initial=np.inf)), np.minimum(other[None], cost.min(2, initial=np.inf))):
            least = np.maximum(least, sides.max(2, initial=0))
        if not n or not m:
            return least
        far_own, far_other = own[:, None] > least[:, :, None], other[None] > least[:, :, None]
        i, j = np.nonzero((far_own.sum(2) > 1) | (far_other.sum(2) > 1))  # one point has its best choice for itself
        near = cost[i, j] <= least[i, j, None, None]
        ok = enough(near, far_own[i, j]) & enough(near.transpose(0, 2, 1), far_other[i, j])
        for k, l in zip(i[~ok], j[~ok], strict=True):
            least[k, l] = searched(cost[k, l], own[k], other[l], least[k, l])
        return least

    return by_size(left, right, tile, lambda n, m: n * m, 200_000)


#: Distances that can be worked out for many pairs at once.
AT_ONCE = {sliced_wasserstein: sliced_wasserstein_all, bottleneck: bottleneck_all}
#: Diagrams that meet a block of the query set in one go.
ROWS = 256


def lists_to_queries(diagrams: DataFrame, distance, every: int = 20, block: int = 64) -> DataFrame:
    """image_id, others, distances: for each diagram and each block of the query set, the block's ids and the distances to them.

    The query set, the images whose id is divisible by ``every``, grows with
    the images. Both sides are gathered in blocks, of about ``block`` diagrams
    of the query set and ``ROWS`` of all; each block meets each once, in a task
    dealt by the two blocks. With ``every`` = 1 the whole matrix comes out. A
    function of two diagrams that isn't in ``AT_ONCE`` is called pair by pair.
    """
    arrays = as_arrays(diagrams)
    n, asked = arrays.agg(F.count("*"), F.count_if(F.pmod("image_id", F.lit(every)) == 0)).first()
    rows, blocks = -(-n // ROWS) or 1, -(-asked // block) or 1
    gathered = lambda x, k, to: x.groupBy(F.pmod(F.xxhash64("image_id"), F.lit(k)).alias(f"{to}_block")).agg(F.collect_list(F.struct("image_id", "points")).alias(to))
    sets = gathered(arrays.where(F.pmod("image_id", F.lit(every)) == 0), blocks, "asked")
    met = gathered(arrays, rows, "own").withColumn("asked_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = met.join(sets, "asked_block").repartition(max(1, min(rows * blocks, 2000)), "own_block", "asked_block").select("own", "asked")
    many = AT_ONCE.get(distance) or (lambda left, right: np.array([[distance(a, b) for b in right] for a in left]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_matrix = lambda rows: [np.array(x["points"], float).reshape(-1, 2) for x in rows]
        for b in batches:
            for own, other in zip(b.column("own"), b.column("asked"), strict=True):
                own, other = (sorted(x.as_py(), key=lambda y: y["image_id"]) for x in (own, other))
                found = many(as_matrix(own), as_matrix(other))
                to = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(other))
                ids = np.tile(np.array([x["image_id"] for x in other], np.int64), len(own))
                yield pa.RecordBatch.from_arrays([pa.array([x["image_id"] for x in own], pa.int64()), *(pa.ListArray.from_arrays(to, pa.array(x)) for x in (ids, found.ravel()))], names=["image_id", "others", "distances"])

    return pairs.mapInArrow(run, "image_id long, others array<long>, distances array<double>")


def vectors_to_queries(diagrams: DataFrame, distance, of, rows: DataFrame, name: str, every: int = 20, numbers: int = 4_000_000) -> DataFrame:
    """``rows`` (image_id and others) that have a diagram, with ``name``: ``of`` the distances to the query set, in order of its ids.

    A task has the whole query set beside as many diagrams as give about
    ``numbers`` distances, so that no distance is shuffled.
    """
    arrays = as_arrays(diagrams)
    n, asked = arrays.agg(F.count("*"), F.count_if(F.pmod("image_id", F.lit(every)) == 0)).first()
    blocks = -(-n // min(max(numbers // max(asked, 1), 64), 2048)) or 1
    tasks = min(4 * blocks, 2000)  # few tasks get two blocks
    own = rows.join(arrays, "image_id").withColumn("block", F.pmod(F.xxhash64("image_id"), F.lit(blocks)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sets = arrays.where(F.pmod("image_id", F.lit(every)) == 0).select(F.col("image_id").alias("other"), F.col("points").alias("other_points"), each.alias("other_block"))
    many = AT_ONCE.get(distance) or (lambda left, right: np.array([[distance(a, b) for b in right] for a in left]))

    def run(own: pa.Table, sets: pa.Table) -> pa.Table:
        own, sets = own.sort_by("image_id"), sets.sort_by("other")
        left, right = ([np.array(p, float).reshape(-1, 2) for p in x.to_pylist()] for x in (own.column("points"), sets.column("other_points")))
        found = many(left, right).reshape(len(left), len(right))
        kept = own.drop_columns(["points", "block"])
        side = max(1, 500_000 // max(1, len(sets)))  # batches of 4 MB
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(sets)), pa.array(x.ravel())) for x in (of(found[i : i + side]) for i in range(0, len(own), side))]
        return kept.append_column(name, pa.chunked_array(lists, pa.list_(pa.float64())))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} array<double>"
    return own.repartition(tasks, "block").groupBy("block").cogroup(sets.repartition(tasks, "other_block").groupBy("other_block")).applyInArrow(run, schema)


def to_queries(diagrams: DataFrame, distance, name: str, every: int = 20, block: int = 64) -> DataFrame:
    """image_id, other, ``name``: the distance of each diagram to each diagram of the query set, as in ``lists_to_queries``."""
    found = lists_to_queries(diagrams, distance, every, block)
    return found.select("image_id", F.inline(F.arrays_zip(F.col("others").alias("other"), F.col("distances").alias(name))))


def kernel(distances: DataFrame, name: str, bandwidth: float) -> DataFrame:
    """exp(-distance / (2 bandwidth^2))."""
    return distances.withColumn("kernel", F.exp(-F.col(name) / (2 * bandwidth * bandwidth)))
