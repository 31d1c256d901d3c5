"""Micro-fields worked out by hand, identities on random fields, and edge cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rasterloom.functions import sql, thresholds
from rasterloom.operators import augment, components, curves, diagrams, features, filtrations, ml, tracking, volumes
from rasterloom.sources import fields as src

SCHEMA = "image_id long, h int, w int, vals array<double>, levels array<double>"


def make(spark, *grids, levels=None):
    """grids: 2-D lists; levels: thresholds for all."""
    rows = []
    for i, g in enumerate(grids):
        a = np.array(g, float)
        rows.append((i, a.shape[0], a.shape[1], [float(x) for x in a.ravel()], [float(x) for x in levels] if levels is not None else None))
    return spark.createDataFrame(rows, SCHEMA)


def measures(df):
    found = {}
    for r in curves.curves(df).orderBy("image_id", "k").collect():
        found.setdefault(r.image_id, []).append((r.area, r.perimeter_open, r.perimeter_closed, r.euler))
    return found


def test_curves_of_micro_fields(spark):
    a = make(spark, [[0, 1], [2, 3]], levels=[0, 1, 2, 3])
    assert measures(a)[0] == [(4, 2, 0, 1), (3, 2, 2, 1), (2, 2, 2, 1), (1, 0, 2, 1)]
    ring = make(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]], levels=[1])
    assert [(m[0], m[2], m[3]) for m in measures(ring)[0]] == [(8, 4, 0)]
    diagonal = make(spark, [[1, 0], [0, 1]], levels=[1])
    assert [(m[0], m[2], m[3]) for m in measures(diagonal)[0]] == [(2, 4, 1)]
    row = make(spark, [[3, 0, 2]], levels=[2])
    assert [(m[0], m[2], m[3]) for m in measures(row)[0]] == [(2, 2, 2)]


def flood(mask, eight=True):
    h, w = mask.shape
    seen, n = np.zeros_like(mask), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or a == 0 or b == 0)]
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not seen[r, c]:
                n += 1
                stack = [(r, c)]
                seen[r, c] = True
                while stack:
                    y, x = stack.pop()
                    for a, b in steps:
                        if 0 <= y + a < h and 0 <= x + b < w and mask[y + a, x + b] and not seen[y + a, x + b]:
                            seen[y + a, x + b] = True
                            stack.append((y + a, x + b))
    return n


def test_curves_equal_direct_counts_on_random_fields(spark):
    rng = np.random.default_rng(1)
    grids = [rng.integers(0, 5, (int(rng.integers(1, 7)), int(rng.integers(1, 7)))).astype(float) for _ in range(40)]
    levels = [0, 1, 2.5, 3, 4, 9]
    found = measures(make(spark, *grids, levels=levels))
    betti = {(r.image_id, r.k): r.components for r in tracking.betti0(make(spark, *grids, levels=levels[::-1])).collect()}
    for i, g in enumerate(grids):
        for k, t in enumerate(levels):
            inside = g >= t
            pairs = [(g[:, :-1], g[:, 1:]), (g[:-1], g[1:])]
            closed = sum(int(((np.minimum(a, b) < t) & (t <= np.maximum(a, b))).sum()) for a, b in pairs)
            open_ = sum(int(((np.minimum(a, b) <= t) & (t < np.maximum(a, b))).sum()) for a, b in pairs)
            holes = flood(~np.pad(inside, 1), eight=False) - 1
            assert found[i][k] == (int(inside.sum()), open_, closed, flood(inside) - holes)
            assert betti[i, len(levels) - 1 - k] == flood(inside)


def test_missing_pixels_are_in_no_set(spark):
    found = measures(make(spark, [[1, math.nan], [1, 1]], levels=[1]))
    assert found[0][0][0] == 3 and found[0][0][3] == 1
    stats = components.component_stats(make(spark, [[1, math.nan], [1, 1]], levels=[1])).collect()
    assert [(s.area, s.birth_k) for s in stats] == [(3, 0)]


def history(df, gem, column):
    return [r[column] for r in df.where(F.col("gem") == gem).orderBy("k").collect()]


def test_two_peaks(spark):
    d = make(spark, [[3, 0, 2], [0, 0, 0], [0, 0, 0]], levels=[3, 2, 1, 0])
    h = tracking.histories(d).cache()
    assert history(h, 1, "per") == [2, 2, 2, 0] and history(h, 1, "area") == [1, 1, 1, 9]
    assert history(h, 2, "per") == [0, 2, 2, 0] and history(h, 2, "area") == [0, 1, 1, 0]
    rows = {r.gem: r for r in tracking.diagram(d).collect()}
    assert (rows[1].life_birth, rows[1].life_death, rows[1].bar_birth, rows[1].bar_death, rows[1].persistence) == (3, 0, 1, 4, 3)
    assert (rows[2].life_birth, rows[2].life_death, rows[2].bar_birth, rows[2].bar_death, rows[2].persistence) == (2, 0, 2, 4, 2)
    assert (rows[1].sum_area, rows[1].sum_per) == (12, 6) and (rows[2].sum_area, rows[2].sum_per) == (2, 4)


def test_tied_peaks_keep_the_higher_number(spark):
    d = make(spark, [[3, 0, 3], [0, 0, 0], [0, 0, 0]], levels=[3, 2, 1, 0])
    h = tracking.histories(d).cache()
    assert history(h, 1, "area") == [1, 1, 1, 0] and history(h, 2, "area") == [1, 1, 1, 9]
    assert [(r.k, r.loser, r.winner) for r in tracking.merges(d).collect()] == [(3, 1, 2)]


def test_essential_and_literal_persistence(spark):
    d = make(spark, [[3, 0, 2]], levels=[3, 2])  # ends above the least value, with boundary at the last level
    rows = {r.gem: r for r in tracking.diagram(d, essential="inf", literal_persistence=True).collect()}
    assert rows[1].life_death == math.inf and rows[2].persistence == 2
    assert {r.life_death for r in tracking.diagram(d).collect()} == {2.0}


def test_constant_and_single_pixel_fields_have_no_diagram(spark):
    assert tracking.diagram(make(spark, [[1, 1], [1, 1]], levels=[1, 1])).count() == 0
    assert tracking.diagram(make(spark, [[5]], levels=[5, 5])).count() == 0
    assert tracking.diagram(make(spark, [[1, 2]], levels=[9, 2, 1])).count() == 1  # empty first level


def simulate(grid, levels, by_perimeter):
    """Sequential reading of the tracker: pairwise comparisons level by level."""

    def label(mask):
        h, w = mask.shape
        out, n = np.zeros(mask.shape, int), 0
        for r in range(h):
            for c in range(w):
                if mask[r, c] and not out[r, c]:
                    n += 1
                    out[r, c], stack = n, [(r, c)]
                    while stack:
                        y, x = stack.pop()
                        for a in (-1, 0, 1):
                            for b in (-1, 0, 1):
                                if 0 <= y + a < h and 0 <= x + b < w and mask[y + a, x + b] and not out[y + a, x + b]:
                                    out[y + a, x + b] = n
                                    stack.append((y + a, x + b))
        return out

    def perimeter(m):
        return int((m[:, 1:] != m[:, :-1]).sum() + (m[1:] != m[:-1]).sum())

    living, births, per, nxt = {}, {}, {}, 1
    for k, t in enumerate(levels):
        lab = label(grid >= t)
        dead = set()
        for i in living:
            for f in living:
                if i < f and lab[living[i]] == lab[living[f]]:
                    if births[i] != births[f]:
                        dead.add(i if births[i] > births[f] else f)
                    elif by_perimeter:
                        dead.add(i if sum(per[i]) <= sum(per[f]) else f)
                    else:
                        dead.add(i)
        for i in dead:
            del living[i]
        held = {lab[p] for p in living.values()}
        for n in range(1, lab.max() + 1):
            if n not in held:
                at = np.argwhere(lab == n)[0]
                living[nxt], births[nxt], per[nxt] = tuple(at), k, [0] * k
                nxt += 1
        for i in births:
            per[i].append(perimeter(lab == lab[living[i]]) if i in living else 0)
    return per


@pytest.mark.parametrize("rule", ["id", "perimeter"])
def test_tracker_equals_sequential_simulation(spark, rule):
    rng = np.random.default_rng(5)
    grids = [rng.integers(0, 4, (5, 6)).astype(float) for _ in range(30)]
    levels = [4, 3, 2, 1, 0]
    found = {}
    for r in tracking.histories(make(spark, *grids, levels=levels), rule).orderBy("k").collect():
        found.setdefault((r.image_id, r.gem), []).append(r.per)
    expected = {(i, g): p for i, grid in enumerate(grids) for g, p in simulate(grid, levels, rule == "perimeter").items()}
    assert found == expected


def test_cubical_persistence_of_a_ring(spark):
    pairs = filtrations.persistence(np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]], float))
    assert (0, 0.0, math.inf) in pairs and (1, 0.0, 1.0) in pairs and len(pairs) == 2


def test_loops_equal_components_of_the_complement(spark):
    rng = np.random.default_rng(2)
    for _ in range(30):
        g = rng.integers(0, 5, (6, 6)).astype(float)
        pairs = filtrations.persistence(g)
        for t in range(5):
            inside = g <= t
            assert sum(d == 0 and b <= t < e for d, b, e in pairs) == flood(inside)
            assert sum(d == 1 and b <= t < e for d, b, e in pairs) == flood(~np.pad(inside, 1), eight=False) - 1


def test_diagram_summaries(spark):
    d = spark.createDataFrame([(0, 0.0, 2.0), (0, 1.0, 3.0), (0, 1.0, 1.0)], "image_id long, birth double, death double")
    r = diagrams.summaries(d, "image_id").first()
    assert (r.points, r.bottleneck) == (2, 1.0) and r.entropy == pytest.approx(1.0) and r.wasserstein == pytest.approx(math.sqrt(2))
    s = {x.i: x for x in diagrams.sampled(d, "image_id", m=4).collect()}
    assert s[1].betti == 2 and s[1].landscape == 1.0


def test_diagram_distances():
    a, b = np.array([[0.0, 4.0]]), np.array([[0.0, 5.0], [1.0, 1.2]])
    assert diagrams.bottleneck(a, b) == 1.0
    assert diagrams.bottleneck(a, a) == 0.0 and diagrams.sliced_wasserstein(a, a) == pytest.approx(0.0)
    assert diagrams.bottleneck(a, np.zeros((0, 2))) == 2.0


def test_distances_to_the_query_set(spark):
    """Every diagram meets every diagram of the query set, whatever the blocks; values against one pair at a time."""
    rng = np.random.default_rng(4)
    points = {i: np.sort(rng.random((rng.integers(1, 5), 2)), axis=1) for i in range(50)}
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, p in points.items() for a, b in p], "image_id long, birth double, death double")
    for f in (diagrams.sliced_wasserstein, diagrams.bottleneck):
        found = {(r.image_id, r.other): r.d for r in diagrams.to_queries(rows, f, "d", every=7, block=2).collect()}
        assert found == {(i, j): pytest.approx(f(points[i], points[j])) for i in points for j in points if j % 7 == 0}


def test_bottleneck_equals_the_best_of_all_matchings():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = (np.sort(rng.random((rng.integers(0, 4), 2)), axis=1) for _ in range(2))
        n, m = len(a), len(b)
        best = math.inf
        for order in itertools.permutations(range(n + m)):  # a's points and m diagonal ones to b's points and n diagonal ones
            worst = 0.0
            for i, j in enumerate(order):
                if i < n and j < m:
                    worst = max(worst, np.abs(a[i] - b[j]).max())
                elif i < n or j < m:
                    x = a[i] if i < n else b[j]
                    worst = max(worst, (x[1] - x[0]) / 2)
            best = min(best, worst)
        assert diagrams.bottleneck(a, b) == pytest.approx(best if n + m else 0.0)


def sequential_pairs(grid, shifts):
    """Components of sublevel sets, pixel by pixel in order of value."""
    h, w = grid.shape
    order, label, born, pairs = np.argsort(grid.ravel(), kind="stable"), {}, {}, []
    for turn, p in enumerate(order.tolist()):
        r, c = divmod(p, w)
        near = {label[q] for dr, dc in shifts if 0 <= r + dr < h and 0 <= c + dc < w and (q := (r + dr) * w + c + dc) in label}
        own = min(near, key=born.get) if near else p
        born.setdefault(own, turn)
        label[p] = own
        for other in near - {own}:
            if grid.flat[order[born[other]]] < grid.flat[p]:
                pairs.append((float(grid.flat[order[born[other]]]), float(grid.flat[p])))
            label = {k: own if v == other else v for k, v in label.items()}
    return sorted(pairs), sorted(float(grid.flat[order[born[x]]]) for x in set(label.values()))


@pytest.mark.parametrize("shifts", [filtrations.SHIFTS, filtrations.FOUR])
def test_merge_tree_equals_pixel_by_pixel(shifts):
    rng = np.random.default_rng(6)
    for k in range(30):
        grid = rng.integers(0, [3, 100][k % 2], rng.integers(1, 9, 2)).astype(float)
        pairs, forever = filtrations.merge_tree(grid, shifts)
        assert (sorted(pairs), sorted(forever)) == sequential_pairs(grid, shifts)


def test_diagrams_of_all_filtrations_in_one_step(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 5, 7, rng.integers(0, 2, 35).astype(float).tolist()) for i in range(6)] + [(9, 3, 3, [0.0] * 9)]
    binary = spark.createDataFrame(rows, "image_id long, h int, w int, vals array<double>")
    centres = ((1.0, 2.0), (2.5, 3.5))
    key = lambda df: sorted((r.image_id, r.filtration, r.dim, round(r.birth, 9), round(r.death, 9)) for r in df.collect())
    assert key(filtrations.all_diagrams(binary, centres)) == key(filtrations.cubical(filtrations.all_filtrations(binary, centres)))


def test_large_fields(spark):
    rows = [(i, [float((i * 64 + k) % 97) for k in range(64)]) for i in range(850)]
    folder = f"{spark.conf.get('spark.checkpoint.dir', 'file:///tmp')}/large"
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    found = {r.image_id: r.vals for r in src.field224(spark, folder).collect()}
    assert sorted(found) == [0, 1] and all(len(v) == 224 * 224 for v in found.values())
    assert found[1][:64] == rows[64][1] and found[0][-64:] == rows[783][1]


def test_images_are_written_and_read_back(spark, tmp_path):
    rows = make(spark, [[0.0, 10.4, 255.0], [300.0, -5.0, 99.6]], [[7.0]])
    src.write_images(rows, f"file://{tmp_path}/plain")
    src.write_images(rows, f"file://{tmp_path}/high", threshold=99.0)
    for name, expected in (("plain", [0, 10, 255, 255, 0, 100]), ("high", [0, 0, 255, 255, 0, 255])):
        found = {r.origin.rsplit("/", 1)[1]: r for r in src.read_images(spark, f"{tmp_path}/{name}").collect()}
        assert (found["0.png"].height, found["0.png"].width, list(bytes(found["0.png"].data))) == (2, 3, expected)
        assert found["1.png"].height == found["1.png"].width == 1


def test_information_of_features(spark):
    """A feature that is the label has its entropy; one that is independent of it, or constant, has none."""
    rows = [(i, k, float(v)) for i in range(40) for k, v in enumerate((i % 2, i // 2 % 2, 5))]
    long = spark.createDataFrame(rows, "image_id long, position int, value double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "image_id long, label int")
    assert [(r.position, r.information) for r in features.most_informative(long, labels, 2).collect()] == [(0, round(math.log(2), 9)), (1, 0.0)]


def test_slices_without_a_mask_are_told(spark):
    vols = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "volume_id long, slice int")
    masks = spark.createDataFrame([(0, 0)], "volume_id long, slice int")
    assert sorted(tuple(r) for r in volumes.without_mask(vols, masks).collect()) == [(0, 1), (1, 0)]


def test_thresholds(spark):
    d = make(spark, [[1, 2, 4]])
    assert thresholds.quantiles(d, 3).first().levels == [4.0, 2.0, 1.0]
    assert thresholds.quantiles(d, 5).first().levels == [4.0, 3.0, 2.0, 1.5, 1.0]
    assert thresholds.even(d, 4).first().levels == [1.0, 2.0, 3.0, 4.0]
    assert thresholds.positive(make(spark, [[-1, 0]]), 3).first().levels is None


def test_slices_and_masks(spark):
    vols = spark.createDataFrame([(0, 0, 1, 2, [5.0, 7.0]), (0, 1, 1, 2, [1.0, 2.0])], "volume_id long, slice int, h int, w int, vals array<double>")
    masks = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [3.0, 1.0])], "volume_id long, slice int, mask array<double>")
    chosen = volumes.chosen_slices(vols, masks).first()
    assert (chosen.slice, chosen.mask_area) == (1, 2)
    assert volumes.prepared(volumes.chosen_slices(vols, masks)).first().vals == [0.0, 1.0]


def test_boundary_correction_and_vectors(spark):
    d = make(spark, [[1, 0], [0, 0]], levels=[1])
    r = features.boundary_corrected(curves.curves(d), 2).first()
    assert r.per == pytest.approx(2 - 4 / 2 * 1)
    assert r.chi == pytest.approx(1 - 4 / (4 * math.pi) * 2 + (1 / (2 * math.pi) * 4 - 0.5))
    long = features.geometric_long(make(spark, [[1, 0], [0, 0]]).withColumn("channel", F.lit(0)), 3)
    assert len(features.to_vector(long).first().features) == 9
    assert len(features.column_names(3)) == 36


def test_augmentation_is_seeded_and_shared_by_channels(spark):
    d = make(spark, np.arange(36).reshape(6, 6))
    a, b = (augment.augmented(d, seed=3).first().vals for _ in range(2))
    assert a == b and a != augment.augmented(d, seed=4).first().vals


def test_splits_and_votes(spark):
    ids = spark.range(100).select(F.col("id").alias("image_id"))
    split = features.hash_split(ids, "image_id", 0.35, 0)
    assert split.where("is_test").count() == 35
    assert sorted(r.place for r in features.shuffled(ids, "image_id", 42).collect()) == list(range(1, 101))
    near = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (0, 0, 0.0)], "image_id long, other long, distance double")
    labels = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "image_id long, label int")
    assert ml.neighbours_vote(near, labels, 3).first().predicted == 7


def test_sql_functions(spark):
    sql.register(spark)
    rows = spark.sql("SELECT * FROM field_curves(array(3D, 0D, 2D), 1, 3, array(3D, 2D, 0D))").collect()
    assert [(r.area, r.perimeter, r.euler, r.components) for r in rows] == [(1, 1, 1, 1), (2, 2, 2, 2), (3, 0, 1, 1)]
    assert spark.sql("SELECT * FROM field_components(array(3D, 0D, 2D), 1, 3, array(2D))").count() == 2


def png(path, rgb):
    import struct
    import zlib

    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[r].astype("uint8").tobytes() for r in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    rgb = np.zeros((2, 3, 3), int)
    rgb[0, 0] = (10, 20, 200)
    for kind in ("benign", "malignant"):
        (tmp_path / "train" / kind).mkdir(parents=True)
        png(tmp_path / "train" / kind / "x.png", rgb)
    (tmp_path / "train" / "benign" / "bad.png").write_bytes(b"no image")
    found = src.with_class(src.read_images(spark, str(tmp_path)))
    assert sorted((r.split, r["class"], r.label) for r in found.collect()) == [("train", "benign", 0), ("train", "malignant", 1)]
    assert src.read_images(spark, str(tmp_path), limit=1).count() == 1
    blue = src.channels(src.read_images(spark, str(tmp_path), 1)).where("channel = 0").first()
    assert (blue.h, blue.w) == (2, 3) and blue.vals == [0.0] + [200.0] * 5
    gray = src.gray_fields(src.read_images(spark, str(tmp_path), 1)).first()
    assert gray.vals == [0.0] + [float(round(0.299 * 10 + 0.587 * 20 + 0.114 * 200))] * 5


def test_stream(spark, tmp_path):
    from rasterloom.streaming import curves as stream

    make(spark, [[1, 2], [3, 4]]).drop("levels").write.parquet(str(tmp_path / "in"))
    query = stream.curve_stream(stream.field_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 3)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_many_distances_at_once_equal_one_pair_at_a_time():
    """With empty diagrams, ties, points on one place, and sizes that greedy matchings don't settle."""
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.random((rng.integers(0, 12), 2)), axis=1) for _ in range(40)]
    sets += [np.sort(rng.integers(0, 4, (rng.integers(0, 12), 2)), axis=1).astype(float) for _ in range(40)]
    sets += [np.array([[0.0, 9.0]] * n + [[1.0, 9.0]]) for n in (0, 1, 3)]
    for one, many in diagrams.AT_ONCE.items():
        assert np.allclose(many(sets, sets[::3]), [[one(a, b) for b in sets[::3]] for a in sets], rtol=0, atol=1e-12)
    big = [np.sort(rng.random((n, 2)), axis=1) for n in (90, 300)]
    assert np.allclose(diagrams.sliced_wasserstein_all(big, sets[:3]), [[diagrams.sliced_wasserstein(a, b) for b in sets[:3]] for a in big], rtol=0, atol=1e-9)
    assert diagrams.bottleneck_all(big, big[:1])[1, 0] == diagrams.bottleneck(big[1], big[0])


def test_kernel_vectors_equal_rows_of_kernels(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i in range(300) for a, b in np.sort(rng.random((3, 2)), axis=1)], "image_id long, birth double, death double")
    pairs = diagrams.kernel(diagrams.to_queries(rows, diagrams.sliced_wasserstein, "d", block=4), "d", 0.5)
    vectors = ml.kernel_vectors(diagrams.lists_to_queries(rows, diagrams.sliced_wasserstein, block=4), 0.5)
    found = {r.image_id: r.features.toArray().tolist() for r in vectors.collect()}
    assert len(found) == 300 and {len(x) for x in found.values()} == {15}
    assert found == {r.image_id: r.features.toArray().tolist() for r in ml.kernel_rows(pairs).collect()}


def test_kernel_features_are_worked_out_where_they_are_put_together(spark):
    """As the lists give them, over several blocks, without a shuffle of what is found; rows without a diagram are left out."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i in range(300) for a, b in rng.random((rng.integers(1, 6), 2))], "image_id long, birth double, death double")
    labels = spark.range(310).select(F.col("id").alias("image_id"), (F.col("id") % 2).cast("double").alias("label"))
    expected = {r.image_id: r.features.toArray() for r in ml.kernel_vectors(diagrams.lists_to_queries(rows, diagrams.sliced_wasserstein, block=4), 0.5).collect()}
    features_ = ml.kernel_features(rows, labels, 0.5)
    blocks = diagrams.vectors_to_queries(rows, diagrams.sliced_wasserstein, lambda x: np.exp(-x / 0.5), labels, "features", numbers=1)
    for found in (features_.collect(), blocks.collect()):
        assert sorted((r.image_id, r.label) for r in found) == [(i, float(i % 2)) for i in range(300)]
        for r in found:
            assert np.allclose(getattr(r.features, "values", r.features), expected[r.image_id], rtol=0, atol=1e-12)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_kernel_machine_is_the_one_with_a_scaler(spark):
    rng = np.random.default_rng(9)
    x = rng.random((200, 12)) * np.arange(12)  # the first column is constant
    y = (x[:, 5] + x[:, 11] + rng.normal(0, 3, 200) > 8).astype(float)
    rows = spark.createDataFrame([(i, a.tolist(), float(b), i % 3 == 0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, label double, is_test boolean")
    rows = rows.select("id", array_to_vector("x").alias("features"), "label", "is_test").coalesce(2)
    train = rows.where("not is_test")
    raw = [[r.rawPrediction[1] for r in m.fit(train).transform(rows).orderBy("id").collect()] for m in (ml.kernel_svm(), ml.kernel_machine())]
    assert np.allclose(*raw, rtol=0, atol=1e-6)
    assert ml.kernel_machine().getMaxBlockSizeInMB() < 0.5
    found = ml.kernel_accuracy(rows).first()
    right = (np.array(raw[0]) > 0) == (y > 0)
    test = np.arange(200) % 3 == 0
    assert found == (133, 67, pytest.approx(right[~test].mean()), pytest.approx(right[test].mean()))
    assert math.isnan(ml.kernel_accuracy(train).first().test_accuracy)


def test_models_read_few_partitions(spark):
    rows = spark.range(0, 1000, 1, 50).select("id", array_to_vector(F.array(*[F.col("id") * 1.0] * 3)).alias("features"))
    few = ml.gathered(rows)
    assert few.rdd.getNumPartitions() == 1 and sorted(r.id for r in few.collect()) == list(range(1000))
    assert ml.gathered(rows.select("id", array_to_vector(F.array_repeat(F.col("id") * 1.0, 2500)).alias("features"))).rdd.getNumPartitions() == 3
    assert ml.gathered(rows.where("id < 0")).count() == 0
    spark.catalog.clearCache()
