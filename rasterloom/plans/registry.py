"""Registered queries over the driver's tables, one for each operator group, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import pixels as px
from rasterloom.functions import thresholds as th
from rasterloom.operators import augment, components, curves, diagrams, features, filtrations, ml, tracking, volumes
from rasterloom.plans import oracle as o
from rasterloom.plans.cache import cut, kept
from rasterloom.sources import fields as src

FLAGSHIP = "lkc_curves"
N, NT = 8, 6  # levels of curves and of trackers

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# -- pixels


@registered(o.query(o.FIELD8, select="SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, max(v) OVER (PARTITION BY image_id) - v AS v FROM f"))
def invert_field(spark, d):
    return src.pixels(src.field8(spark, d).withColumn("vals", src.inverted(F.col("vals"))))


@registered(o.query(o.RGBG4, select="SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM f WHERE channel = 0"))
def channel_split(spark, d):
    return src.pixels(src.rgbg4(spark, d).where("channel = 0"))


def _bytes(spark, d) -> DataFrame:
    """The first three channels side by side as display bytes (128 + 256 v, clipped)."""
    e = src.doubles("embedding")
    at = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos")
    rows = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), e.alias("e"), at)
    return rows.select("image_id", "pos", *[px.display_byte(128 + 256 * F.get("e", F.col("pos") + 16 * k)).alias(n) for k, n in enumerate("bgr")])


_BYTES = "px AS (SELECT vec_id AS image_id, CAST(i AS INTEGER) AS pos, " + ", ".join(f"CAST(trunc(greatest(least(128 + 256 * CAST(embedding[i + {16 * k + 1}] AS DOUBLE), 255.0), 0.0)) AS INTEGER) AS {n}" for k, n in enumerate("bgr")) + " FROM embeddings, (SELECT unnest(range(16)) AS i) t)"


@registered(o.query(_BYTES, select="SELECT * FROM px"))
def display_clip(spark, d):
    return _bytes(spark, d)


@registered(o.query(_BYTES, select="SELECT image_id, pos, round(0.299 * CAST(r AS DOUBLE) + 0.587 * CAST(g AS DOUBLE) + 0.114 * CAST(b AS DOUBLE)) AS gray FROM px"))
def gray_projection(spark, d):
    return _bytes(spark, d).select("image_id", "pos", px.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))


@registered(o.query(_BYTES, select="SELECT image_id, pos, " + ", ".join(f"CASE WHEN greatest(b, g, r) >= 128 THEN {x} ELSE 0 END AS {x}" for x in "bgr") + " FROM px"))
def high_intensity_filter(spark, d):
    b, g, r = px.bright_or_black(F.col("b"), F.col("g"), F.col("r"))
    return _bytes(spark, d).select("image_id", "pos", b.alias("b"), g.alias("g"), r.alias("r"))


@registered(o.query(o.FIELD8, select="SELECT image_id, CAST(r AS INTEGER) AS r, CAST(7 - c AS INTEGER) AS c, v FROM f"))
def flip_horizontal(spark, d):
    return src.pixels(src.field8(spark, d).withColumn("vals", px.flipped(F.col("vals"), F.col("h"), F.col("w"), True)))


@registered()
def augmented_fields(spark, d):
    return augment.augmented(src.field8(spark, d).drop("label"), seed=1).select("image_id", F.transform("vals", lambda v: F.round(v, 9)).alias("vals"))


# -- thresholds


@registered(o.query(o.FIELD8, o.levels(N), select="SELECT image_id, k, t FROM lv"))
def linspace_thresholds(spark, d):
    return th.exploded(th.even(src.field8(spark, d), N))


@registered(o.query(o.FIELD8, o.levels(N, descending=True), select="SELECT image_id, k, t FROM lv"))
def descending_thresholds(spark, d):
    return th.exploded(th.even(src.field8(spark, d), N, descending=True))


@registered(o.query(o.SALES, o.quantile_levels(10), select="SELECT image_id, k, t FROM lv"))
def quantile_thresholds(spark, d):
    return th.exploded(th.quantiles(src.sales_raster(spark, d), 10))


@registered(o.query(o.FIELD8, "rng AS (SELECT image_id, min(v) AS mn, max(v) AS mx FROM f WHERE v > 0 GROUP BY ALL)", select=f"SELECT image_id, CAST(k AS INTEGER) AS k, {o.linspace(N)} AS t FROM rng, (SELECT unnest(range({N})) AS k) s"))
def positive_thresholds(spark, d):
    return th.exploded(th.positive(src.field8(spark, d), N).where("levels is not null"))


# -- curves

_FIELDS8 = o.query(o.FIELD8, o.levels(N), o.curves(), select="SELECT image_id, k, t, area, perimeter_closed, perimeter_open, euler FROM cur")


def _curves8(spark, d) -> DataFrame:
    return curves.curves(th.even(src.field8(spark, d), N))


@registered(_FIELDS8)
def lkc_curves(spark, d):
    return _curves8(spark, d)


for _name, _column in (("area_curve", "area"), ("perimeter_open", "perimeter_open"), ("perimeter_closed", "perimeter_closed"), ("euler_curve", "euler")):

    def _one(spark, d, column=_column):
        return _curves8(spark, d).select("image_id", "k", "t", column)

    _one.__name__ = _name
    registered(_FIELDS8.replace("area, perimeter_closed, perimeter_open, euler FROM cur", f"{_column} FROM cur"))(_one)


@registered(o.query(o.SALES, o.levels(N), o.curves(), select="SELECT image_id, k, t, area, perimeter_closed, perimeter_open, euler FROM cur"))
def euler_rect(spark, d):
    return curves.curves(th.even(src.sales_raster(spark, d), N))


@registered(o.query(o.EVENTS, o.levels(N), o.curves(), select="SELECT image_id, k, t, area, perimeter_closed, perimeter_open, euler FROM cur"))
def event_curves(spark, d):
    return curves.curves(th.even(src.event_raster(spark, d), N))


# -- volumes


def _chosen(spark, d) -> DataFrame:
    return volumes.chosen_slices(src.volume4(spark, d), src.mask4(spark, d))


@registered(o.query(o.VOLUME, select="SELECT DISTINCT volume_id, CAST(slice AS INTEGER) AS slice, CAST(mask_area AS BIGINT) AS mask_area FROM cs"))
def slice_select(spark, d):
    return _chosen(spark, d).select("volume_id", "slice", "mask_area")


_MEAN = "zz AS (SELECT volume_id, pos, m, v * m AS x, avg(v * m) OVER (PARTITION BY volume_id) AS mean, stddev_pop(v * m) OVER (PARTITION BY volume_id) AS dev FROM cs), zs AS (SELECT volume_id, pos, m, (x - mean) / nullif(dev, 0) AS z FROM zz)"


@registered(o.query(o.VOLUME, _MEAN, select="SELECT volume_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN m > 0 THEN z - min(z) OVER (PARTITION BY volume_id) ELSE 0.0 END, 6) AS v FROM zs"))
def masked_zscore(spark, d):
    return volumes.prepared(_chosen(spark, d), z_score=True).select("volume_id", F.posexplode("vals").alias("pos", "v")).select("volume_id", "pos", F.round("v", 6).alias("v"))


@registered(o.query(o.VOLUME, o.COHORT, select="SELECT mn AS low, mx AS high FROM co"))
def cohort_range(spark, d):
    return th.cohort(volumes.positive_range(volumes.prepared(_chosen(spark, d))))


_SLICE = "f AS (SELECT volume_id, pos // 4 AS r, pos % 4 AS c, v FROM pl)"


@registered(o.query(o.VOLUME, o.COHORT, _SLICE, f"lv AS (SELECT volume_id, CAST(k AS INTEGER) AS k, {o.linspace(N)} AS t FROM (SELECT DISTINCT volume_id FROM pl) p, co, (SELECT unnest(range({N})) AS k) s)", o.curves("volume_id"), select="SELECT volume_id, k, t, area, perimeter_open, euler FROM cur"))
def eap_range_curve(spark, d):
    return volumes.eap_curves_in_range(_chosen(spark, d), N)


_POSITIVE = f"""zp AS (SELECT volume_id, pos, CASE WHEN m > 0 THEN z - min(z) OVER (PARTITION BY volume_id) ELSE 0.0 END AS v FROM zs), f AS (SELECT volume_id, pos // 4 AS r, pos % 4 AS c, v FROM zp),
rng AS (SELECT volume_id, min(v) AS mn, max(v) AS mx FROM f WHERE v > 0 GROUP BY ALL), lv AS (SELECT volume_id, CAST(k AS INTEGER) AS k, {o.linspace(N)} AS t FROM rng, (SELECT unnest(range({N})) AS k) s)"""


@registered(o.query(o.VOLUME, _MEAN, _POSITIVE, o.curves("volume_id"), select="SELECT volume_id, k, round(t, 6) AS t, area, perimeter_open, euler FROM cur"))
def eap_curve(spark, d):
    return volumes.eap_curves(_chosen(spark, d), N).withColumn("t", F.round("t", 6))


@registered(o.query(o.VOLUME, o.COHORT, select=f"SELECT volume_id, CAST(slice AS INTEGER) AS slice, CAST({N - 1} - k AS INTEGER) AS k, {o.linspace(N)} AS t FROM (SELECT DISTINCT volume_id, slice FROM pl) p, co, (SELECT unnest(range({N})) AS k) s"))
def prepared_volume(spark, d):
    return th.exploded(volumes.cohort_levels(volumes.prepared(_chosen(spark, d)), N, descending=True), "volume_id", "slice")


# -- features


@registered(o.query(o.RGBG4, o.levels(4, "image_id, channel"), o.curves("image_id, channel"), select="""SELECT image_id, CAST(4 * j + channel AS INTEGER) AS block, CAST((4 * j + channel) * 4 + k AS INTEGER) AS position,
  CAST(CASE j WHEN 0 THEN area WHEN 1 THEN perimeter_open ELSE euler END AS DOUBLE) AS value FROM cur, (SELECT unnest(range(3)) AS j) b"""))  # fmt: skip
def geometric_vector(spark, d):
    return features.geometric_long(src.rgbg4(spark, d), 4)


_PI = "CAST(pi() AS DOUBLE)"


@registered(o.query(o.FIELD8, o.levels(N, descending=True), o.curves(), select=f"SELECT image_id, k, CAST(area AS DOUBLE) AS area, round(perimeter_closed - CAST(4.0 AS DOUBLE) / 8 * area, 6) AS per, round(euler - CAST(4.0 AS DOUBLE) / (2 * {_PI} * 8) * perimeter_closed + (1 / (2 * {_PI}) * 0.25 - CAST(0.125 AS DOUBLE)) * area, 6) AS chi FROM cur"))
def boundary_corrected(spark, d):
    found = features.boundary_corrected(curves.curves(th.even(src.field8(spark, d), N, descending=True)), 8)
    return found.select("image_id", "k", "area", F.round("per", 6).alias("per"), F.round("chi", 6).alias("chi"))


# -- components and trackers

_T8 = (o.FIELD8, o.levels(NT, descending=True))


def _tracked(spark, d) -> DataFrame:
    return th.even(src.field8(spark, d), NT, descending=True)


@registered(o.query(*_T8, o.labels(8, 8), select="SELECT image_id, k, CAST(pix AS INTEGER) AS pix, CAST(comp AS INTEGER) AS comp FROM lab", recursive=True))
def component_labels(spark, d):
    return components.component_labels(_tracked(spark, d))


@registered(o.query(*_T8, o.labels(8, 8), select="SELECT lv.image_id, lv.k, count(DISTINCT comp) AS components FROM lv LEFT JOIN lab ON lab.image_id = lv.image_id AND lab.k = lv.k GROUP BY ALL", recursive=True))
def betti0_curve(spark, d):
    return tracking.betti0(_tracked(spark, d))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("norm_per", F.round("norm_per", 6))


@registered(o.query(*_T8, o.tracker(8, 8), select=o.DIAGRAM.format(last="at_last", length="d - b"), recursive=True))
def h0_diagram(spark, d):
    return _rounded(tracking.diagram(_tracked(spark, d)))


@registered(o.query(*_T8, o.tracker(8, 8), select=o.DIAGRAM.format(last="at_last", length="CASE WHEN d >= n THEN n ELSE d - b END"), recursive=True))
def h0_diagram_literal(spark, d):
    return _rounded(tracking.diagram(_tracked(spark, d), literal_persistence=True))


@registered(o.query(*_T8, o.tracker(8, 8, "perimeter"), select=o.DIAGRAM.format(last="CAST('inf' AS DOUBLE)", length="d - b"), recursive=True))
def h0_summary(spark, d):
    return _rounded(tracking.diagram(_tracked(spark, d), rule="perimeter", essential="inf"))


@registered(o.query(*_T8, o.tracker(8, 8, "perimeter"), select=o.DIAGRAM.format(last="at_last", length="d - b"), recursive=True))
def h0_summary_last(spark, d):
    return _rounded(tracking.diagram(_tracked(spark, d), rule="perimeter"))


@registered(o.query(o.FIELD8, o.quantile_levels(NT), o.tracker(8, 8), select=o.DIAGRAM.format(last="at_last", length="d - b"), recursive=True))
def h0_quantile_diagram(spark, d):
    return _rounded(tracking.diagram(th.quantiles(src.field8(spark, d), NT)))


@registered(o.query(*_T8, o.tracker(8, 8), select="SELECT image_id, CAST(gem AS INTEGER) AS gem, CAST(rep AS INTEGER) AS rep, k, CAST(per AS BIGINT) AS per, CAST(area AS BIGINT) AS area, CAST(chi AS BIGINT) AS chi FROM hist", recursive=True))
def component_history(spark, d):
    return tracking.histories(_tracked(spark, d))


@registered(o.query(*_T8, o.tracker(8, 8), select="SELECT image_id, CAST(gem AS INTEGER) AS loser, min(k) AS k, CAST(arg_min(winner, k) AS INTEGER) AS winner FROM champ WHERE winner <> gem GROUP BY ALL", recursive=True))
def merge_links(spark, d):
    return tracking.merges(_tracked(spark, d))


@registered(o.query(*_T8, o.tracker(8, 8), select="SELECT h.image_id, h.k, round(sum(h.per / CAST(i.sum_area AS DOUBLE)), 6) AS profile FROM hist h JOIN iv i ON i.image_id = h.image_id AND i.gem = h.gem WHERE i.sum_area > 0 GROUP BY ALL", recursive=True))
def norm_perimeter_profile(spark, d):
    return tracking.perimeter_profile(_tracked(spark, d)).select("image_id", "k", F.round("profile", 6).alias("profile"))


_WD = "wd AS (SELECT image_id, gem, norm_per * CASE WHEN d >= n THEN at_last ELSE at_death END AS birth, norm_per * life_birth AS death FROM dg)"
_WV = _WD.replace("norm_per", "sum_per")


def _weighted(spark, d, weight="norm_per") -> DataFrame:
    return diagrams.weighted(tracking.diagram(_tracked(spark, d)), weight)


@registered(o.query(*_T8, o.tracker(8, 8), _WD, select="SELECT image_id, CAST(gem AS INTEGER) AS gem, round(birth, 6) AS birth, round(death, 6) AS death FROM wd", recursive=True))
def weighted_diagram(spark, d):
    return _weighted(spark, d).select("image_id", "gem", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))


@registered(o.query(*_T8, o.tracker(8, 8), _WV, "pl AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gem) AS place FROM wd)", select="SELECT image_id, CAST(gem AS INTEGER) AS gem, round(birth, 6) AS birth, round(death, 6) AS death FROM pl WHERE place > 1", recursive=True))
def variation_diagram(spark, d):
    return diagrams.without_first(_weighted(spark, d, "sum_per")).select("image_id", "gem", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))


_SUMS = """ll AS (SELECT image_id, death - birth AS l FROM wd WHERE death > birth),
sm AS (SELECT image_id, count(*) AS points, sum(l) AS s, sum(l * log2(l)) AS sl, max(l) / 2 AS bottleneck, sqrt(sum(l / 2 * (l / 2))) AS wasserstein FROM ll GROUP BY ALL)"""


@registered(o.query(*_T8, o.tracker(8, 8), _WD, _SUMS, select="SELECT image_id, points, round(log2(s) - sl / s, 6) AS entropy, round(coalesce((log2(s) - sl / s) / nullif(log2(s), 0), -1), 6) AS normalized_entropy, round(bottleneck, 6) AS bottleneck, round(wasserstein, 6) AS wasserstein FROM sm", recursive=True))
def entropy_amplitudes(spark, d):
    found = diagrams.summaries(_weighted(spark, d), "image_id")
    return found.select("image_id", "points", *[F.round(c, 6).alias(c) for c in ("entropy", "normalized_entropy", "bottleneck", "wasserstein")])


_GRID = "gr AS (SELECT min(birth) AS low, (max(death) - min(birth)) / CAST(99 AS DOUBLE) AS step FROM wd)"
_TENT = """gx AS (SELECT w.image_id, i, birth, death, low + CAST(i AS DOUBLE) * step AS x, step FROM wd w, gr, (SELECT unnest(range(100)) AS i) t WHERE death > birth),
tt AS (SELECT *, greatest(least(x - birth, death - x), 0.0) AS tent FROM gx), sw AS (SELECT image_id, sum(death - birth) AS weight FROM wd WHERE death > birth GROUP BY ALL),
sp AS (SELECT tt.image_id, i, any_value(step) AS step, count(*) FILTER (WHERE birth <= x AND x < death) AS betti, max(tent) AS landscape, sum((death - birth) * tent) / any_value(weight) AS silhouette FROM tt JOIN sw ON sw.image_id = tt.image_id GROUP BY ALL)"""


@registered(o.query(*_T8, o.tracker(8, 8), _WD, _GRID, _TENT, select="SELECT image_id, " + ", ".join(f"round(sqrt(any_value(step) * sum(CAST({c} AS DOUBLE) * {c})), 5) AS {c}" for c in ("betti", "landscape", "silhouette")) + " FROM sp GROUP BY ALL", recursive=True))
def sampled_amplitudes(spark, d):
    found = diagrams.sampled_amplitudes(_weighted(spark, d), "image_id")
    return found.select("image_id", *[F.round(c, 5).alias(c) for c in ("betti", "landscape", "silhouette")])


@registered(o.query(*_T8, o.tracker(8, 8), _WD, _GRID, _TENT, "ly AS (SELECT image_id, i, tent, row_number() OVER (PARTITION BY image_id, i ORDER BY tent DESC) AS layer FROM tt WHERE tent > 0)", select="SELECT image_id, CAST(i AS INTEGER) AS i, CAST(layer AS INTEGER) AS layer, round(tent, 5) AS value FROM ly WHERE layer <= 2 AND round(tent, 5) > 0", recursive=True))
def landscape_layers(spark, d):
    return diagrams.landscape_layers(_weighted(spark, d), "image_id").withColumn("value", F.round("value", 5)).where("value > 0")


def _bump(at: str, x: str) -> str:
    return f"exp(-(({x}) - ({at})) * (({x}) - ({at})) / (2 * s * s)) / (sqrt(2 * pi()) * s)"


_BUMPS = f"""en AS (SELECT min(birth) AS low, max(death) - min(birth) AS width, (max(death) - min(birth)) * CAST(0.1 AS DOUBLE) AS s FROM wd),
pt AS (SELECT image_id, birth, death, death - birth AS life, low, width, s FROM wd, en WHERE death > birth), pl AS (SELECT CAST(unnest(range(20)) AS DOUBLE) / 19 AS u),
cl AS (SELECT image_id, any_value(width) / 19 AS step, CAST(round(19 * x.u) AS INTEGER) AS i, CAST(round(19 * y.u) AS INTEGER) AS j,
  sum({_bump("birth", "low + width * x.u")} * {_bump("death", "low + width * y.u")} - {_bump("birth", "low + width * y.u")} * {_bump("death", "low + width * x.u")}) AS heat,
  sum(life * {_bump("birth", "low + width * x.u")} * {_bump("life", "width * y.u")}) AS image FROM pt, pl x, pl y GROUP BY ALL)"""


@registered(o.query(*_T8, o.tracker(8, 8), _WD, _BUMPS, select="SELECT image_id, round(any_value(step) * sqrt(sum(heat * heat)), 6) AS heat, round(any_value(step) * sqrt(sum(image * image)), 6) AS persistence_image FROM cl GROUP BY ALL", recursive=True))
def gaussian_amplitudes(spark, d):
    found = diagrams.gaussian_images(_weighted(spark, d), "image_id")
    return found.select("image_id", F.round("heat", 6).alias("heat"), F.round("persistence_image", 6).alias("persistence_image"))


@registered(o.query(*_T8, o.tracker(8, 8), _WD, _BUMPS, select="SELECT image_id, j * 20 + i AS place, round(image, 6) AS value FROM cl WHERE round(image, 6) > 0", recursive=True))
def persistence_image(spark, d):
    return diagrams.persistence_images(_weighted(spark, d), "image_id").withColumn("value", F.round("value", 6)).where("value > 0")


@registered(o.query(*_T8, o.tracker(8, 8), _WD, "fi AS (SELECT * FROM wd WHERE death > birth)", select="""SELECT image_id, CAST(gem AS INTEGER) AS gem, round((birth - (SELECT min(birth) FROM fi)) / nullif((SELECT max(birth) - min(birth) FROM fi), 0), 6) AS birth,
  round((death - (SELECT min(death) FROM fi)) / nullif((SELECT max(death) - min(death) FROM fi), 0), 6) AS death FROM fi""", recursive=True))  # fmt: skip
def scaled_diagram(spark, d):
    found = diagrams.min_max(diagrams.finite(_weighted(spark, d)))
    return found.select("image_id", "gem", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))


# -- filtrations


_BIN = "bi AS (SELECT image_id, pos, r, c, CASE WHEN v / (SELECT nullif(max(v), 0) FROM f) > 0.4 THEN 1.0 ELSE 0.0 END AS v FROM f)"
#: Centres of radial filtrations in pixels of an 8x8 field.
CENTRES8 = tuple((7 * a, 7 * b) for a, b in filtrations.CENTRES)


def _binary(spark, d) -> DataFrame:
    return filtrations.binarized(src.field8(spark, d))


@registered(o.query(o.FIELD8, _BIN, select="SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(v AS DOUBLE) AS v FROM bi"))
def binarize(spark, d):
    return src.pixels(_binary(spark, d))


def _filtration_sql(value: str) -> str:
    return o.query(o.FIELD8, _BIN, f"pv AS (SELECT image_id, r, c, v, {value} AS x FROM bi)", select="SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CASE WHEN v > 0 THEN x ELSE max(x) OVER (PARTITION BY image_id) + 1 END, 6) AS v FROM pv")


@registered(_filtration_sql("(r + c) / sqrt(CAST(2 AS DOUBLE))"))
def height_filtration(spark, d):
    return src.pixels(filtrations.height(_binary(spark, d), (1, 1))).withColumn("v", F.round("v", 6))


@registered(_filtration_sql("sqrt((r - 3.5) * (r - 3.5) + (c - 3.5) * (c - 3.5))"))
def radial_filtration(spark, d):
    return src.pixels(filtrations.radial(_binary(spark, d), (3.5, 3.5))).withColumn("v", F.round("v", 6))


@registered()
def cubical_persistence(spark, d):
    return filtrations.cubical(src.field8(spark, d))


_FORMS = [(f"height_{n}", f"(r * {a} + c * {b}) / sqrt(CAST({a * a + b * b} AS DOUBLE)) + {7 * ((a < 0) + (b < 0))} / sqrt(CAST({a * a + b * b} AS DOUBLE))") for n, (a, b) in enumerate(filtrations.DIRECTIONS)]
_FORMS += [(f"radial_{n}", f"sqrt((r - {a}) * (r - {a}) + (c - {b}) * (c - {b}))") for n, (a, b) in enumerate(CENTRES8)]
_PLACED = "pv AS (" + " UNION ALL ".join(f"SELECT image_id, '{n}' AS filtration, pos, v, CAST({x} AS DOUBLE) AS x FROM bi" for n, x in _FORMS) + ")"


@registered(o.query(o.FIELD8, _BIN, _PLACED, select="SELECT image_id, filtration, CAST(pos AS INTEGER) AS pos, round(CASE WHEN v > 0 THEN x ELSE max(x) OVER (PARTITION BY image_id, filtration) + 1 END, 6) AS v FROM pv"))
def filtration_values(spark, d):
    """Pixels of all 17 filtrations: eight directions, nine centres."""
    found = filtrations.all_filtrations(_binary(spark, d), CENTRES8)
    return found.select("image_id", "filtration", F.posexplode("vals").alias("pos", "v")).withColumn("v", F.round("v", 6))


@registered()
def filtration_features(spark, d):
    """image_id, filtration, dim and eight features of each of 17 filtrations in two dimensions, after scaling each by its collection."""
    keys = ("image_id", "filtration", "dim")
    points = kept(diagrams.finite(filtrations.all_diagrams(_binary(spark, d), CENTRES8)))
    points = diagrams.scaled_by_amplitude(points, "filtration", "dim")
    base, sampled, blurred = diagrams.summaries(points, *keys), diagrams.sampled_amplitudes(points, *keys, m=50), diagrams.gaussian_images(points, *keys, m=20)
    joined = base.join(sampled, list(keys)).join(blurred, list(keys))
    names = ("entropy", "bottleneck", "wasserstein", "betti", "landscape", "silhouette", "heat", "persistence_image")
    return joined.select(*keys, *[F.round(c, 6).alias(c) for c in names])


# -- distances


def _scaled(spark, d) -> DataFrame:
    """Diagrams scaled to 0..1, computed once: the distances read them several times, and a model's plan must not hold what they came from."""
    return cut(diagrams.min_max(diagrams.finite(kept(_weighted(spark, d)))))


@registered()
def sliced_wasserstein_kernel(spark, d):
    found = diagrams.kernel(diagrams.to_queries(_scaled(spark, d), diagrams.sliced_wasserstein, "distance"), "distance", 1.0)
    return found.select("image_id", "other", F.round("distance", 6).alias("distance"), F.round("kernel", 6).alias("kernel"))


@registered()
def bottleneck_distances(spark, d):
    return diagrams.to_queries(_scaled(spark, d), diagrams.bottleneck, "distance").withColumn("distance", F.round("distance", 6))


_SUBJECT = "sb AS (SELECT vec_id AS image_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"


@registered(o.query(_SUBJECT, "ds AS (SELECT a.image_id, b.image_id AS other, b.label, abs(a.x - b.x) + abs(a.y - b.y) AS distance FROM sb a JOIN sb b ON a.image_id % 20 = 0 AND a.image_id <> b.image_id)", "nr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, other) AS place FROM ds)", "vt AS (SELECT image_id, label, count(*) AS n FROM nr WHERE place <= 5 GROUP BY ALL)", "bt AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS place FROM vt)", select="SELECT image_id, label AS predicted FROM bt WHERE place = 1"))
def knn_vote(spark, d):
    """Votes on the query set over precomputed distances (here of two coordinates): the operator takes the distance table as given."""
    e = src.doubles("embedding")
    points = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.get(e, 0).alias("x"), F.get(e, 1).alias("y"), "label")
    pairs = ml.query_pairs(points.drop("label"))
    distances = pairs.select("image_id", F.col("other_image_id").alias("other"), (F.abs(F.col("x") - F.col("other_x")) + F.abs(F.col("y") - F.col("other_y"))).alias("distance"))
    return ml.neighbours_vote(distances, points.select("image_id", "label"))


# -- tables, splits and models


def _draw(seed: int) -> str:
    return f"((image_id + {seed}) * 48271 + CAST(floor((image_id + {seed}) / CAST(7 AS DOUBLE)) AS BIGINT) * 69621 + 12345) % 2147483647"


def _ids(spark, d) -> DataFrame:
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label")


@registered(f"WITH e AS (SELECT vec_id AS image_id, label FROM embeddings), p AS (SELECT image_id, label, row_number() OVER (ORDER BY {_draw(0)}, image_id) AS place FROM e) SELECT image_id, label, place <= floor((SELECT count(*) FROM e) * CAST(0.35 AS DOUBLE)) AS is_test FROM p")
def hash_split(spark, d):
    return features.hash_split(_ids(spark, d), "image_id", 0.35, 0)


@registered(f"WITH e AS (SELECT vec_id AS image_id, label FROM embeddings) SELECT image_id, label, row_number() OVER (ORDER BY {_draw(42)}, image_id) AS place FROM e")
def seeded_shuffle(spark, d):
    return features.shuffled(_ids(spark, d), "image_id", 42).drop("draw")


@registered("SELECT vec_id AS image_id, label, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) WHERE place <= 20")
def per_class_top_n(spark, d):
    return features.top_per_class(_ids(spark, d), 20, "image_id", "label")


@registered("SELECT label, array_to_string(list(vec_id ORDER BY vec_id), ',') AS ids, count(*) AS n FROM embeddings GROUP BY label")
def class_index_lists(spark, d):
    return ml.class_lists(_ids(spark, d), "label", "image_id").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@registered("SELECT label, CAST(dense_rank() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS DOUBLE) AS label_index, count(*) AS n FROM embeddings GROUP BY label")
def label_encoding(spark, d):
    return ml.indexed(_ids(spark, d), "label").groupBy("label", "label_index").agg(F.count("*").alias("n"))


@registered(o.query(o.FIELD8, o.levels(N), o.curves(), "w AS (SELECT image_id, max(area) FILTER (WHERE k = 3) AS a, max(euler) FILTER (WHERE k = 5) AS x FROM cur GROUP BY ALL)", select="SELECT image_id, round((a - (SELECT avg(a) FROM w)) / (SELECT nullif(stddev_pop(a), 0) FROM w), 6) AS a, round((x - (SELECT avg(x) FROM w)) / (SELECT nullif(stddev_pop(x), 0) FROM w), 6) AS x FROM w"))
def standard_scaler(spark, d):
    wide = _curves8(spark, d).groupBy("image_id").agg(F.max(F.when(F.col("k") == 3, F.col("area"))).cast("double").alias("a"), F.max(F.when(F.col("k") == 5, F.col("euler"))).cast("double").alias("x"))
    return ml.standardized(wide, ["a", "x"]).select("image_id", F.round("a", 6).alias("a"), F.round("x", 6).alias("x"))


def _fused(spark, d) -> DataFrame:
    fields = th.even(src.field8(spark, d), N, descending=True)
    corrected = features.boundary_corrected(curves.curves(fields), 8)
    sums = diagrams.summaries(diagrams.weighted(tracking.diagram(fields), "norm_per"), "image_id")
    columns = F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).cast("double").alias("value")) for i, c in enumerate(("points", "bottleneck", "wasserstein"))])
    return features.fused(corrected, sums.select("image_id", F.inline(columns)), sums.select("image_id", F.col("normalized_entropy").alias("entropy")), N)


_TOPOLOGY = " UNION ALL ".join(f"SELECT image_id, {i} AS position, CAST({c} AS DOUBLE) AS value FROM sm" for i, c in enumerate(("points", "bottleneck", "wasserstein")))
_CORRECTED = {"area": "area", "per": "perimeter_closed - 4.0 / CAST(8 AS DOUBLE) * area", "chi": f"euler - CAST(4.0 AS DOUBLE) / (2 * {_PI} * 8) * perimeter_closed + (1 / (2 * {_PI}) * 0.25 - CAST(0.125 AS DOUBLE)) * area"}
_FUSED = f"""fz AS ({_TOPOLOGY} UNION ALL {" UNION ALL ".join(f"SELECT image_id, {3 + N * j} + k, CAST({x} AS DOUBLE) FROM cur" for j, x in enumerate(_CORRECTED.values()))}
UNION ALL SELECT image_id, {3 + 3 * N}, coalesce((log2(s) - sl / s) / nullif(log2(s), 0), -1) FROM sm)"""


@registered(o.query(o.FIELD8, o.levels(N, descending=True), o.curves(), o.tracker(8, 8), _WD, _SUMS, _FUSED, select="SELECT image_id, CAST(position AS INTEGER) AS position, round(value, 6) AS value FROM fz", recursive=True))
def fused_features(spark, d):
    return _fused(spark, d).withColumn("value", F.round("value", 6))


_INFORMATION = """fv AS (SELECT image_id, (4 * j + channel) * 4 + k AS position, CAST(CASE j WHEN 0 THEN area WHEN 1 THEN perimeter_open ELSE euler END AS DOUBLE) AS value FROM cur, (SELECT unnest(range(3)) AS j) b),
rf AS (SELECT position, min(value) AS low, max(value) AS high FROM fv GROUP BY ALL),
bn AS (SELECT fv.position, CASE WHEN high > low THEN least(floor((value - low) / (high - low) * 10), 9) ELSE 0 END AS bin, label FROM fv JOIN rf ON rf.position = fv.position JOIN embeddings e ON e.vec_id = fv.image_id),
bo AS (SELECT position, bin, label, count(*) AS n FROM bn GROUP BY ALL),
mi AS (SELECT *, sum(n) OVER (PARTITION BY position, bin) AS nb, sum(n) OVER (PARTITION BY position, label) AS nl, sum(n) OVER (PARTITION BY position) AS nt FROM bo),
ms AS (SELECT position, round(sum(n / CAST(nt AS DOUBLE) * ln(n * nt / CAST(nb * nl AS DOUBLE))), 9) AS information FROM mi GROUP BY ALL)"""


@registered(o.query(o.RGBG4, o.levels(4, "image_id, channel"), o.curves("image_id, channel"), _INFORMATION, select="SELECT CAST(position AS INTEGER) AS position, round(information, 6) AS information FROM ms ORDER BY ms.information DESC, position LIMIT 20"))
def most_informative(spark, d):
    return features.most_informative(features.geometric_long(src.rgbg4(spark, d), 4), _ids(spark, d), 20).withColumn("information", F.round("information", 6))


@registered()
def forest_accuracy(spark, d):
    split = features.hash_split(_ids(spark, d), "image_id", 0.35, 0)
    rows = features.to_vector(features.geometric_long(src.rgbg4(spark, d), 4)).join(split, "image_id")
    return ml.forest_accuracy(rows, trees=20)


def _two_classes(spark, d) -> DataFrame:
    return _ids(spark, d).withColumn("label", (F.col("label") >= 5).cast("double"))


@registered()
def grid_search(spark, d):
    rows = features.to_vector(features.geometric_long(src.rgbg4(spark, d), 4)).join(_two_classes(spark, d), "image_id")
    return ml.grid_search(cut(rows))


@registered()
def kernel_svm(spark, d):
    """Accuracy in training and in test of a machine over kernel values to the query set."""
    split = cut(features.hash_split(_two_classes(spark, d), "image_id", 0.35, 0))
    return ml.kernel_accuracy(cut(ml.kernel_features(_scaled(spark, d), split, 1.0)))
