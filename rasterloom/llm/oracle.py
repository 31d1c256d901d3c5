"""SQL, for DuckDB, of the operators that it can express over whole tables."""

from __future__ import annotations


def shingled(table: str, id_: str, name: str) -> str:
    """name(id, sh): five-word shingles, with repetitions; all words as one where there are one to four."""
    return f"""{name}_w AS (SELECT {id_} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS ws FROM {table} WHERE text IS NOT NULL),
{name} AS (SELECT id, len(ws) AS words, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS sh FROM {name}_w WHERE len(ws) > 0)"""


OP8 = f"""WITH {shingled("documents", "doc_id", "d")}, {shingled("benchmark", "item_id", "b")},
ds AS (SELECT DISTINCT id, sh FROM d WHERE words >= 5), bs AS (SELECT DISTINCT id, sh FROM b WHERE words >= 5),
bn AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
m AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared FROM ds JOIN bs ON ds.sh = bs.sh GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, shared, shared / CAST(n AS DOUBLE) AS containment FROM m JOIN bn ON bn.id = m.item_id WHERE shared >= 0.8 * n"""

OP10 = f"""WITH RECURSIVE {shingled("documents", "doc_id", "d")},
c AS (SELECT id, sh, row_number() OVER (PARTITION BY id, sh) AS nth FROM d),
n AS (SELECT id, count(*) AS n FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM c a JOIN c b ON a.sh = b.sh AND a.nth = b.nth AND a.id <> b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE m >= 0.8 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS class_id, count(*) > 1 AS in_group FROM r GROUP BY a)
SELECT doc_id, class_id, in_group FROM k"""


def op4(order: int) -> str:
    """The rules, and Witten-Bell models of both classes level by level."""
    rules = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(h, p, v)}'" for h, p, v in rules) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    levels = []
    for k in range(order + 1):
        low = f"JOIN l{k - 1} low ON low.g = right(v.g, {k})" if k else ""
        under = (lambda x: f"low.{x}") if k else (lambda x: "1.0 / ((SELECT count(DISTINCT right(g, 1)) FROM g) + 1)")
        mixed = lambda n, total, kinds, x: f"CASE WHEN {total} > 0 THEN ({n} + {kinds} * {under(x)}) / ({total} + {kinds}) ELSE {under(x)} END AS {x}"  # noqa: E731,B023
        levels.append(f"""v{k} AS (SELECT right(g, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
s{k} AS (SELECT left(g, {k}) AS c, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE b > 0) AS tb FROM v{k} GROUP BY ALL),
l{k} AS (SELECT v.g, {mixed("v.a", "na", "ta", "pa")}, {mixed("v.b", "nb", "tb", "pb")} FROM v{k} v JOIN s{k} ON s{k}.c = left(v.g, {k}) {low})""")
    return f"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
j AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS fixed, nullif(translate(rest, '{upper}123456789', '{lower}000000000'), '') AS norm FROM h),
t AS (SELECT norm, count(*) FILTER (WHERE fixed = 'allow') AS a, count(*) FILTER (WHERE fixed = 'block') AS b FROM j WHERE norm IS NOT NULL GROUP BY ALL),
o AS (SELECT norm, a, b, unnest(range(1, len(norm) + 1)) AS i FROM t),
og AS (SELECT norm, a, b, substr(repeat(chr(2), {order}) || norm, i, {order + 1}) AS g FROM o),
g AS (SELECT g, sum(a) AS a, sum(b) AS b FROM og GROUP BY ALL),
{", ".join(levels)},
z AS (SELECT norm, any_value(a) AS a, any_value(b) AS b, round(avg(ln(pa) - ln(pb)), 9) AS score FROM og JOIN l{order} ON l{order}.g = og.g GROUP BY norm),
th AS (SELECT coalesce((sum(score * a) / nullif(sum(a), 0) + sum(score * b) / nullif(sum(b), 0)) / 2, 0) AS threshold FROM z)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN score >= (SELECT threshold FROM th) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM j LEFT JOIN z ON z.norm = j.norm"""


OP3 = """WITH r AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS raw FROM documents),
s AS (SELECT doc_id, raw, octet_length(raw) AS n FROM r),
w AS (SELECT doc_id, unnest(range(0, n - 399)) AS pos, hex(raw) AS hx FROM s WHERE n >= 400),
k AS (SELECT doc_id, pos, md5(substr(hx, 2 * pos + 1, 800)) AS f FROM w),
x AS (SELECT f FROM k GROUP BY f HAVING count(*) > 1),
p AS (SELECT k.doc_id, pos FROM k JOIN x ON x.f = k.f),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400 THEN 0 ELSE 1 END AS new FROM p)),
c AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 400 AS b FROM g GROUP BY ALL),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM c),
q AS (SELECT e.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(hex(raw), 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(hex(any_value(raw)), 2 * max(b) + 1) AS left_over FROM e JOIN s ON s.doc_id = e.doc_id GROUP BY ALL),
w2 AS (SELECT doc_id, unnest(range(0, n - 199)) AS pos, hex(raw) AS hx FROM s WHERE n >= 200),
k2 AS (SELECT doc_id, pos, md5(substr(hx, 2 * pos + 1, 400)) AS f FROM w2),
x2 AS (SELECT f FROM k2 GROUP BY f HAVING count(*) > 1),
p2 AS (SELECT k2.doc_id, pos FROM k2 JOIN x2 ON x2.f = k2.f),
g2 AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM p2)),
c2 AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS b FROM g2 GROUP BY ALL),
b2 AS (SELECT doc_id, a, regexp_extract_all(substr(hex(raw), 2 * a + 1, 2 * (b - a)), '..') AS p FROM c2 JOIN s USING (doc_id)),
y2 AS (SELECT doc_id, a FROM b2 WHERE len(list_filter(p, lambda x, i: x NOT IN ('20', '09', '0A', '0B', '0C', '0D') AND (i = 1 OR p[i - 1] IN ('20', '09', '0A', '0B', '0C', '0D')))) > 50),
z2 AS (SELECT doc_id, count(*) AS n_passages FROM y2 GROUP BY ALL)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN q.doc_id IS NULL THEN raw ELSE unhex(left_over) END) AS kept_sha256, coalesce(n_passages, 0) AS n_passages
FROM s LEFT JOIN q ON q.doc_id = s.doc_id LEFT JOIN z2 ON z2.doc_id = s.doc_id"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
