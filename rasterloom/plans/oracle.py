"""SQL for the registered queries, written for DuckDB over the driver's tables.

Built from a few common table expressions: fields as pixel rows, levels, the
direct (not event-based) curves, and components by recursive reachability.
"""

from __future__ import annotations

FIELD8 = "f AS (SELECT vec_id AS image_id, i // 8 AS r, i % 8 AS c, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) t)"
RGBG4 = "f AS (SELECT vec_id AS image_id, i // 16 AS channel, (i % 16) // 4 AS r, i % 4 AS c, i % 16 AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) t)"
SALES = """n AS (SELECT CAST(ascii(l_returnflag) AS BIGINT) AS image_id, (CAST(floor(l_quantity) AS INTEGER) - 1) * 11 + CAST(round(l_discount * 100) AS INTEGER) AS pos, count(*) AS n
  FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.10 GROUP BY 1, 2),
f AS (SELECT g.image_id, i // 11 AS r, i % 11 AS c, i AS pos, CAST(coalesce(n.n, 0) AS DOUBLE) AS v
  FROM (SELECT DISTINCT image_id FROM n) g CROSS JOIN (SELECT unnest(range(550)) AS i) t LEFT JOIN n ON n.image_id = g.image_id AND n.pos = t.i)"""
EVENTS = """n AS (SELECT image_id, (day(ts) - 1) * 24 + hour(ts) AS pos, count(*) AS n FROM (SELECT ts, dense_rank() OVER (ORDER BY event_type) AS image_id FROM events) GROUP BY 1, 2),
f AS (SELECT g.image_id, i // 24 AS r, i % 24 AS c, i AS pos, CAST(coalesce(n.n, 0) AS DOUBLE) AS v
  FROM (SELECT DISTINCT image_id FROM n) g CROSS JOIN (SELECT unnest(range(744)) AS i) t LEFT JOIN n ON n.image_id = g.image_id AND n.pos = t.i)"""


def linspace(n: int, low: str = "mn", high: str = "mx") -> str:
    return f"CASE WHEN k = {n - 1} THEN {high} ELSE {low} + CAST(k AS DOUBLE) * (({high} - {low}) / CAST({n - 1} AS DOUBLE)) END"


def levels(n: int, keys: str = "image_id", descending: bool = False) -> str:
    k = f"{n - 1} - k" if descending else "k"
    return f"""rng AS (SELECT {keys}, min(v) AS mn, max(v) AS mx FROM f GROUP BY {keys}),
lv AS (SELECT {keys}, CAST({k} AS INTEGER) AS k, {linspace(n)} AS t FROM rng, (SELECT unnest(range({n})) AS k) s)"""


def curves(keys: str = "image_id") -> str:
    """cur: direct counts of pixels, pairs and 2x2 quads at each level of lv over the pixels f."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    pick = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f"""ar AS (SELECT {pick('lv')}, lv.k, count(*) FILTER (WHERE f.v >= lv.t) AS area FROM lv JOIN f ON {on('lv', 'f')} GROUP BY ALL),
pr AS (SELECT {pick('a')}, least(a.v, b.v) AS lo, greatest(a.v, b.v) AS hi FROM f a JOIN f b ON {on('a', 'b')} AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c))),
pe AS (SELECT {pick('lv')}, lv.k, count(*) FILTER (WHERE lo < t AND t <= hi) AS perimeter_closed, count(*) FILTER (WHERE lo <= t AND t < hi) AS perimeter_open FROM lv JOIN pr ON {on('lv', 'pr')} GROUP BY ALL),
vx AS (SELECT {keys}, r + dr AS vr, c + dc AS vc, max(v) FILTER (WHERE dr = 1 AND dc = 1) AS nw, max(v) FILTER (WHERE dr = 1 AND dc = 0) AS ne,
  max(v) FILTER (WHERE dr = 0 AND dc = 1) AS sw, max(v) FILTER (WHERE dr = 0 AND dc = 0) AS se FROM f, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc) d GROUP BY ALL),
qd AS (SELECT {pick('lv')}, lv.k, CAST(coalesce(nw >= t, false) AS INTEGER) AS a, CAST(coalesce(ne >= t, false) AS INTEGER) AS b,
  CAST(coalesce(sw >= t, false) AS INTEGER) AS cc, CAST(coalesce(se >= t, false) AS INTEGER) AS d FROM lv JOIN vx ON {on('lv', 'vx')}),
eu AS (SELECT {keys}, k, CAST((count(*) FILTER (WHERE a + b + cc + d = 1) - count(*) FILTER (WHERE a + b + cc + d = 3) - 2 * count(*) FILTER (WHERE a + b + cc + d = 2 AND a = d)) / 4 AS BIGINT) AS euler FROM qd GROUP BY ALL),
cur AS (SELECT {pick('lv')}, lv.k, lv.t, area, coalesce(perimeter_closed, 0) AS perimeter_closed, coalesce(perimeter_open, 0) AS perimeter_open, euler
  FROM lv JOIN ar ON {on('lv', 'ar')} AND lv.k = ar.k LEFT JOIN pe ON {on('lv', 'pe')} AND lv.k = pe.k JOIN eu ON {on('lv', 'eu')} AND lv.k = eu.k)"""


def labels(h: int, w: int) -> str:
    """lab: image_id, k, pix, comp of every pixel in each level's set, by reachability from pixels that could be first."""
    return f"""ps AS (SELECT unnest(range({h * w})) AS pos),
adj AS (SELECT a.pos, b.pos AS npos FROM ps a, ps b WHERE a.pos <> b.pos AND abs(a.pos // {w} - b.pos // {w}) <= 1 AND abs(a.pos % {w} - b.pos % {w}) <= 1),
px AS (SELECT lv.image_id, lv.k, f.pos FROM lv JOIN f ON f.image_id = lv.image_id AND f.v >= lv.t),
seed AS (SELECT p.image_id, p.k, p.pos FROM px p LEFT JOIN adj d ON d.pos = p.pos AND d.npos < p.pos LEFT JOIN px q ON q.image_id = p.image_id AND q.k = p.k AND q.pos = d.npos GROUP BY ALL HAVING count(q.pos) = 0),
reach AS (SELECT image_id, k, pos AS s, pos FROM seed UNION
  SELECT p.image_id, p.k, a.s, p.pos FROM reach a JOIN adj d ON d.pos = a.pos JOIN px p ON p.image_id = a.image_id AND p.k = a.k AND p.pos = d.npos),
lab AS (SELECT image_id, k, pos AS pix, min(s) AS comp FROM reach GROUP BY ALL)"""


def tracker(h: int, w: int, rule: str = "id") -> str:
    """Component measures, births, champions, deaths, histories and intervals."""
    order = "birth_k, gem DESC" if rule == "id" else "birth_k, before DESC, gem DESC"
    return f"""{labels(h, w)},
k0 AS (SELECT image_id, pix, min(k) AS k0 FROM lab GROUP BY ALL),
ad4 AS (SELECT a.pos, b.pos AS npos FROM ps a, ps b WHERE abs(a.pos // {w} - b.pos // {w}) + abs(a.pos % {w} - b.pos % {w}) = 1),
pp AS (SELECT l.image_id, l.k, l.comp, count(*) AS per FROM lab l JOIN ad4 d ON d.pos = l.pix LEFT JOIN lab m ON m.image_id = l.image_id AND m.k = l.k AND m.pix = d.npos WHERE m.pix IS NULL GROUP BY ALL),
cells AS (SELECT image_id, k, comp, count(DISTINCT (pix // {w} + dr) * {w + 1} + pix % {w} + dc) AS nv FROM lab, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc) d GROUP BY ALL),
edges AS (SELECT image_id, k, comp, count(DISTINCT CASE WHEN o < 2 THEN (pix // {w} + o) * {w} + pix % {w} ELSE {(h + 1) * w} + (pix // {w}) * {w + 1} + pix % {w} + o - 2 END) AS ne FROM lab, (SELECT unnest(range(4)) AS o) d GROUP BY ALL),
sz AS (SELECT l.image_id, l.k, l.comp, count(*) AS area, min(k0) AS birth_k FROM lab l JOIN k0 ON k0.image_id = l.image_id AND k0.pix = l.pix GROUP BY ALL),
cst AS (SELECT sz.image_id, sz.k, sz.comp, area, birth_k, coalesce(per, 0) AS per, nv - ne + area AS chi FROM sz JOIN cells USING (image_id, k, comp) JOIN edges USING (image_id, k, comp) LEFT JOIN pp USING (image_id, k, comp)),
gem AS (SELECT image_id, comp AS rep, birth_k, row_number() OVER (PARTITION BY image_id ORDER BY birth_k, comp) AS gem FROM cst WHERE birth_k = k),
occ0 AS (SELECT g.image_id, g.gem, g.rep, g.birth_k, l.k, l.comp, s.per, s.area, s.chi FROM gem g JOIN lab l ON l.image_id = g.image_id AND l.pix = g.rep AND l.k >= g.birth_k JOIN cst s ON s.image_id = l.image_id AND s.k = l.k AND s.comp = l.comp),
occ AS (SELECT *, coalesce(sum(per) OVER (PARTITION BY image_id, gem ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM occ0),
champ AS (SELECT *, first_value(gem) OVER (PARTITION BY image_id, k, comp ORDER BY {order}) AS winner FROM occ),
death AS (SELECT image_id, gem, min(k) FILTER (WHERE winner <> gem) AS death_k FROM champ GROUP BY ALL),
live AS (SELECT c.* FROM champ c JOIN death d ON d.image_id = c.image_id AND d.gem = c.gem WHERE d.death_k IS NULL OR c.k < d.death_k),
nl AS (SELECT image_id, count(*) AS n FROM lv GROUP BY ALL),
hist AS (SELECT g.image_id, g.gem, g.rep, lv.k, coalesce(l.per, 0) AS per, coalesce(l.area, 0) AS area, coalesce(l.chi, 0) AS chi
  FROM gem g JOIN lv ON lv.image_id = g.image_id LEFT JOIN live l ON l.image_id = g.image_id AND l.gem = g.gem AND l.k = lv.k),
iv AS (SELECT image_id, gem, rep, min(k) FILTER (WHERE per > 0) AS b, max(k) FILTER (WHERE per > 0) + 1 AS d, sum(per) AS sum_per, sum(area) AS sum_area, sqrt(CAST(sum(per * per) AS DOUBLE)) AS norm_per FROM hist GROUP BY ALL),
dg AS (SELECT iv.*, n, lb.t AS life_birth, le.t AS at_last, ld.t AS at_death FROM iv JOIN nl ON nl.image_id = iv.image_id JOIN lv lb ON lb.image_id = iv.image_id AND lb.k = iv.b
  JOIN lv le ON le.image_id = iv.image_id AND le.k = n - 1 LEFT JOIN lv ld ON ld.image_id = iv.image_id AND ld.k = iv.d WHERE b IS NOT NULL)"""


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


DIAGRAM = "SELECT image_id, CAST(gem AS INTEGER) AS gem, CAST(rep AS INTEGER) AS rep, CAST(b AS INTEGER) AS b, CAST(d AS INTEGER) AS d, life_birth, CASE WHEN d >= n THEN {last} ELSE at_death END AS life_death, CAST(b + 1 AS INTEGER) AS bar_birth, CAST(d + 1 AS INTEGER) AS bar_death, CAST({length} AS INTEGER) AS persistence, CAST(sum_per AS BIGINT) AS sum_per, CAST(sum_area AS BIGINT) AS sum_area, round(norm_per, 6) AS norm_per FROM dg"


def quantile_levels(n: int) -> str:
    return f"""so AS (SELECT image_id, list_sort(list(v)) AS s FROM f GROUP BY ALL),
qr AS (SELECT image_id, s, CAST({n - 1} - k AS INTEGER) AS k, CAST(k AS DOUBLE) / CAST({n - 1} AS DOUBLE) * (len(s) - 1) AS q FROM so, (SELECT unnest(range({n})) AS k) t),
lv AS (SELECT image_id, k, s[CAST(floor(q) AS BIGINT) + 1] + (s[least(CAST(floor(q) AS BIGINT) + 1, len(s) - 1) + 1] - s[CAST(floor(q) AS BIGINT) + 1]) * (q - floor(q)) AS t FROM qr)"""


VOLUME = """vol AS (SELECT vec_id AS volume_id, i // 16 AS slice, i % 16 AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS i) t),
msk AS (SELECT (SELECT max(vec_id) FROM embeddings) - volume_id AS volume_id, slice, pos, CASE WHEN v > 0 THEN 1 ELSE 0 END AS m FROM vol),
vm AS (SELECT vol.volume_id, vol.slice, vol.pos, vol.v, m FROM vol JOIN msk ON msk.volume_id = vol.volume_id AND msk.slice = vol.slice AND msk.pos = vol.pos),
ch AS (SELECT volume_id, slice, sum(m) AS mask_area, row_number() OVER (PARTITION BY volume_id ORDER BY sum(m) DESC, slice) AS place FROM vm GROUP BY volume_id, slice),
cs AS (SELECT vm.*, mask_area FROM vm JOIN ch ON ch.volume_id = vm.volume_id AND ch.slice = vm.slice AND ch.place = 1),
pl AS (SELECT volume_id, slice, pos, m, CASE WHEN m > 0 THEN v * m - min(v * m) OVER (PARTITION BY volume_id) ELSE 0.0 END AS v FROM cs)"""
COHORT = "rg AS (SELECT volume_id, min(v) FILTER (WHERE v > 0) AS low, max(v) FILTER (WHERE v > 0) AS high FROM pl GROUP BY ALL), co AS (SELECT max(low) AS mn, min(high) AS mx FROM rg WHERE low IS NOT NULL)"
