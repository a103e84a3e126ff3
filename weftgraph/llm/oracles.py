"""SQL (DuckDB) of the llm queries that SQL can express."""

from __future__ import annotations

from weftgraph.llm.quality import ALPHA, BASE_RISKS, DELTA, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Pareto mix: targets by filling sources in order of limit over weight, probabilities by words, ranks from md5 uniforms.
OP1 = rf"""
WITH d AS (SELECT doc_id AS id, source AS src, len({_WORDS}) AS size,
  (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS total, count(*) AS docs FROM d GROUP BY src),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, CAST(total * 3 AS DOUBLE) AS lim FROM s0),
s2 AS (SELECT *, sum(total) OVER () - coalesce(sum(lim) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS wrest FROM s1
  WINDOW b AS (ORDER BY lim / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, rest / wrest AS share, lim <= w * (rest / wrest) AS fill, row_number() OVER (ORDER BY lim / w, src NULLS LAST) AS o FROM s2),
lv AS (SELECT arg_min(share, o) AS level FROM s3 WHERE NOT fill),
s4 AS (SELECT src, total, docs, CASE WHEN fill THEN lim ELSE w * level END AS target FROM s3, lv),
s5 AS (SELECT *, floor(CASE WHEN total > 0 THEN target / total ELSE 0.0::DOUBLE END) AS whole FROM s4),
s6 AS (SELECT *, target - whole * total AS need FROM s5),
z0 AS (SELECT src, size, sum(size) AS w, sum(CAST(size AS HUGEINT) * size) AS wx FROM d GROUP BY src, size),
z1 AS (SELECT src, size, coalesce(sum(w) OVER (PARTITION BY src ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  CAST(sum(wx) OVER (PARTITION BY src ORDER BY size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS q FROM z0),
z2 AS (SELECT z1.src, z1.size, (need - c) / q AS lam FROM z1 JOIN s6 ON z1.src IS NOT DISTINCT FROM s6.src WHERE q > 0),
z AS (SELECT src, max(size) AS most, arg_max(lam, size) AS lam FROM z2 WHERE lam * size <= 1 GROUP BY src),
r0 AS (SELECT d.*, total, docs, target, whole, need, most, greatest(lam * size, 1e-12::DOUBLE) AS p FROM d JOIN s6 ON d.src IS NOT DISTINCT FROM s6.src LEFT JOIN z ON z.src IS NOT DISTINCT FROM d.src),
r1 AS (SELECT *, coalesce(size > most OR p >= 1, false) AS sure FROM r0),
r2 AS (SELECT *, CASE WHEN sure THEN 0.0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS rk FROM r1),
r3 AS (SELECT *, CASE WHEN sure THEN -1 ELSE floor(rk / (rk + 1) * ceil(docs / 4096.0::DOUBLE)) END AS b FROM r2),
g0 AS (SELECT src, b, rk, id, size, any_value(need) AS need, sum(size) AS words FROM r3 WHERE need > 0 GROUP BY src, b, rk, id, size),
g1 AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY b, rk, id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum,
  sum(words) OVER (PARTITION BY src ORDER BY b RANGE UNBOUNDED PRECEDING) AS upto, sum(words) OVER (PARTITION BY src, b) AS here FROM g0),
e AS (SELECT src, min(b) AS eb FROM g1 WHERE b >= 0 AND upto - here <= need AND upto >= need GROUP BY src),
g2 AS (SELECT g1.*, eb, b < eb OR b = eb AND cum <= need AS fits FROM g1 JOIN e ON g1.src IS NOT DISTINCT FROM e.src),
g3 AS (SELECT *, need - coalesce(max(CASE WHEN fits THEN cum END) OVER (PARTITION BY src), 0) AS gap FROM g2),
g4 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(gap - words), rk, id NULLS FIRST, size) AS o FROM g3 WHERE b = eb AND NOT fits AND words > 0 AND abs(gap - words) < gap),
t AS (SELECT src, b, rk, id, size FROM g3 WHERE fits UNION ALL SELECT src, b, rk, id, size FROM g4 WHERE o = 1)
SELECT r3.id AS doc_id, CAST(r3.size AS BIGINT) AS size, total AS source_size, target,
  CAST(least(whole + CASE WHEN t.b IS NULL THEN 0 ELSE 1 END, 3) AS BIGINT) * r3.size AS taken
FROM r3 LEFT JOIN t ON t.src IS NOT DISTINCT FROM r3.src AND t.b = r3.b AND t.rk = r3.rk AND t.id IS NOT DISTINCT FROM r3.id AND t.size = r3.size
"""

#: Substring dedup: every 35-word window written out.
OP2 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
dup AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
u AS (SELECT r, unnest(ws) AS wd, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT u.r, u.wd, u.i, max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.r ORDER BY u.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM u LEFT JOIN dup ON dup.r = u.r AND dup.i = u.i),
k AS (SELECT r, count(*) AS n, CAST(sum(gone) AS BIGINT) AS m, string_agg(wd, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM c GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""

#: Byte-level dedup: every 200-byte window as hex digits (cut from stretches, so no long text is scanned for each), kept bytes put together again.
OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, k, substr(x, 2 * k + 1, 2 * 1199) AS y FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199, 1000)) AS k FROM d WHERE length(x) >= 400)),
w AS (SELECT r, k + j AS i, md5_number(substr(y, 2 * j + 1, 400)) AS g FROM (SELECT r, k, y, unnest(range(0, least(1000, length(y) // 2 - 199))) AS j FROM b)),
u AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM u),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM n) GROUP BY r, g),
e AS (SELECT r, z AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS z FROM (SELECT r, a, z FROM s UNION ALL SELECT r, -1, 0 FROM d)),
k AS (SELECT d.r, string_agg(substr(x, 2 * e.a + 1, 2 * (coalesce(e.z, length(x) // 2) - e.a)), '' ORDER BY e.a) AS kept FROM d JOIN e ON e.r = d.r GROUP BY d.r),
t AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS m, count(*) AS c FROM s GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(m, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON k.r = d.r LEFT JOIN t ON t.r = d.r
"""

_RULES = list(RULES.values())
_VALUES = ", ".join(f"CAST({expr} AS DOUBLE)" for expr, _ in _RULES)
_GRID = ", ".join(f"({i}, {j}, {c}::DOUBLE)" for i, (_, grid) in enumerate(_RULES, 1) for j, c in enumerate(grid))
_RISKS = ", ".join(f"({ALPHA}::DOUBLE * {x}::DOUBLE)" for x in BASE_RISKS)


def _proved(k: str, n: str, risk: str, level: str) -> str:
    """The binomial test as SQL: all terms of the distribution function."""
    cdf = f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({risk}) + ({n} - i) * ln(1 - {risk}))))"
    return f"({n} > 0 AND {k} < {n} * {risk} AND {cdf} <= {level})"


#: Quality rules: features, trials by distinct text, binomial bounds, cutoffs, verdicts.
OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
dup AS (SELECT win.r, i FROM win JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) x ON x.r = win.r AND x.g = win.g),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS j FROM dup) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, t, struct_pack(n_words := len(ws), word_chars := length(array_to_string(ws, '')), n_symbols := len(regexp_extract_all(t, '[#*$%&|<>]')),
  n_dup_lines := len(ls) - len(list_distinct(ls)), n_repeat_words := coalesce(n, 0), n_upper := len(regexp_extract_all(t, '[A-Z]')),
  n_punct := len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')), n_lines := len(ls)) AS _f FROM d JOIN ln ON ln.r = d.r LEFT JOIN rep ON rep.r = d.r),
v AS (SELECT *, _f.n_words < 10 OR 100 * _f.n_repeat_words > 20 * _f.n_words AS base, [{_VALUES}] AS vs FROM f),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tr AS (SELECT lang, t, any_value(base) AS base, any_value(vs) AS vs, max(g) AS g FROM v JOIN m ON m.doc_id = v.doc_id GROUP BY lang, t),
st AS (SELECT lang, CAST(sum(g) AS BIGINT) AS n, CAST(sum(CASE WHEN base THEN g ELSE 0 END) AS BIGINT) AS lost, {DELTA}::DOUBLE / (count(*) OVER () * {len(_RULES) + 1}) AS level FROM tr GROUP BY lang),
br AS (SELECT lang, min(x) AS b FROM st, (SELECT unnest([{_RISKS}]) AS x) WHERE {_proved("lost", "n", "x", f"level / {len(BASE_RISKS)}")} GROUP BY lang),
sr AS (SELECT st.*, ({ALPHA}::DOUBLE - b) / {len(_RULES)} AS risk FROM st JOIN br ON br.lang IS NOT DISTINCT FROM st.lang WHERE b < {ALPHA}),
gr(rule, i, cut) AS (VALUES {_GRID}),
k AS (SELECT sr.lang, rule, i, cut, any_value(n) AS n, any_value(risk) AS risk, any_value(level) AS level,
  count(CASE WHEN NOT base AND vs[rule] > cut AND g = 1 THEN 1 END) AS k, count(CASE WHEN NOT base AND vs[rule] > cut AND g = 0 THEN 1 END) AS b
  FROM sr JOIN tr ON tr.lang IS NOT DISTINCT FROM sr.lang CROSS JOIN gr GROUP BY sr.lang, rule, i, cut),
ok AS (SELECT *, bool_and({_proved("k", "n", "risk", "level")}) OVER (PARTITION BY lang, rule ORDER BY i) AS safe FROM k),
c AS (SELECT lang, rule, arg_max(cut, (b - k) * 1000 - i) AS cut FROM ok WHERE safe AND b > k GROUP BY lang, rule),
j AS (SELECT v.r, bool_or(vs[rule] > cut) AS hit FROM v JOIN c ON c.lang IS NOT DISTINCT FROM v.lang GROUP BY v.r)
SELECT doc_id, CAST(_f.n_words AS BIGINT) AS n_words, CAST(_f.word_chars AS BIGINT) AS word_chars, CAST(_f.n_symbols AS BIGINT) AS n_symbols, CAST(_f.n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(_f.n_repeat_words AS BIGINT) AS n_repeat_words, base AS base_failed, NOT base AND NOT coalesce(hit, false) AS kept FROM v LEFT JOIN j ON j.r = v.r
"""

#: Jaccard join: all intersections by a join on 5-word runs, classes by recursion.
OP8 = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT u, v FROM p JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 9 * k >= 4 * (x.n + y.n)),
cc(r, c) USING KEY (r) AS (SELECT r, r FROM w
  UNION SELECT e.u, min(cc.c) FROM e JOIN cc ON cc.r = e.v JOIN recurring.cc o ON o.r = e.u WHERE cc.c < o.c GROUP BY e.u),
m AS (SELECT cc.r, min(w.doc_id) OVER (PARTITION BY cc.c) AS class_id FROM cc JOIN w ON w.r = cc.r),
l AS (SELECT u AS r, count(*) AS n_links FROM e GROUP BY u)
SELECT w.doc_id, m.class_id, coalesce(l.n_links, 0) AS n_links FROM w JOIN m USING (r) LEFT JOIN l USING (r)
"""

#: CRC-32 of strings in a table ``names(g)``: a bit matrix is linear, so each byte adds a term that depends on it and on the bytes behind it.
_CRC = """
RECURSIVE one AS (SELECT i AS b, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS z FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
hx AS (SELECT g, hex(encode(g)) AS x FROM names),
most AS (SELECT max(length(x)) // 2 AS n FROM hx),
term(k, b, z) AS (SELECT 0, b, z FROM one UNION ALL SELECT k + 1, t.b, xor(t.z >> 8, o.z) FROM term t JOIN one o ON o.b = t.z & 255 WHERE k + 1 < (SELECT n FROM most)),
init(k, z) AS (SELECT CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT) UNION ALL SELECT k + 1, xor(i.z >> 8, o.z) FROM init i JOIN one o ON o.b = i.z & 255 WHERE k < (SELECT n FROM most)),
byte AS (SELECT g, len(x) // 2 - 1 - k AS k, len(x) // 2 AS n, CAST(('0x' || substr(x, 2 * k + 1, 2)) AS BIGINT) AS b FROM (SELECT g, x, unnest(range(0, len(x) // 2)) AS k FROM hx)),
crc AS (SELECT g, xor(xor(bit_xor(term.z), any_value(init.z)), 4294967295) AS crc FROM byte JOIN term ON term.k = byte.k AND term.b = byte.b JOIN init ON init.k = byte.n GROUP BY g)
"""

#: Importance resampling: every feature written out, its CRC taken byte by byte.
OP11 = rf"""
WITH src AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
f AS (SELECT kind, r, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT kind, r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
names AS MATERIALIZED (SELECT DISTINCT g FROM f),
made AS MATERIALIZED (WITH {_CRC} SELECT g, crc % 10000 AS b FROM crc),
c AS MATERIALIZED (SELECT kind, r, b, count(*) AS n FROM f JOIN made USING (g) GROUP BY kind, r, b),
k AS (SELECT b, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t FROM c GROUP BY b),
a AS (SELECT sum(s) AS sa, sum(t) AS ta FROM k),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS v FROM k, a),
x AS (SELECT r, sum(n) AS n, sum(n * v) AS weight FROM c JOIN gain USING (b) WHERE kind = 0 GROUP BY r),
d AS (SELECT w.doc_id, len(ws) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN x USING (r) WHERE kind = 0),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, words) AS p, count(*) OVER (PARTITION BY words >= 20) AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND p <= 5 * able // 100 THEN p END AS rank FROM o
"""

#: Periodic runs: pairs of equal words on the grid of every period, three in a row, then islands of equal words for the periods left.
OP13 = rf"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
names AS MATERIALIZED (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS g FROM src WHERE doc_id IS NOT NULL),
made AS MATERIALIZED (WITH {_CRC} SELECT g, crc AS h FROM crc),
b AS (SELECT r, doc_id, ws, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS hit FROM src LEFT JOIN made ON made.g = CAST(doc_id AS VARCHAR)),
p AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM b),
v AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN hit THEN list_concat(ws[1 : a], list_transform(range(a, n), lambda i: ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))])) ELSE ws END AS ws FROM p),
u AS MATERIALIZED (SELECT r, unnest(ws) AS wd, generate_subscripts(ws, 1) - 1 AS i FROM v),
pr AS (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM v WHERE n >= 6),
gp AS (SELECT r, q, unnest(range(0, (n - 1) // q)) AS j FROM pr),
eq AS (SELECT gp.r, q, j FROM gp JOIN u x ON x.r = gp.r AND x.i = j * q JOIN u y ON y.r = gp.r AND y.i = (j + 1) * q WHERE x.wd = y.wd),
cand AS (SELECT DISTINCT r, q FROM (SELECT r, q, j, lead(j, 2) OVER (PARTITION BY r, q ORDER BY j) AS k FROM eq) WHERE k = j + 2),
e2 AS (SELECT c.r, q, x.i, x.i - row_number() OVER (PARTITION BY c.r, q ORDER BY x.i) AS isl FROM cand c JOIN u x ON x.r = c.r JOIN u y ON y.r = c.r AND y.i = x.i + q WHERE x.wd = y.wd),
st AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM e2 GROUP BY r, q, isl HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT r, s, len, min(q) AS q FROM st GROUP BY r, s, len),
drp AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT u.r, string_agg(wd, ' ' ORDER BY u.i) AS t FROM u LEFT JOIN drp ON drp.r = u.r AND drp.i = u.i WHERE drp.i IS NULL GROUP BY u.r),
ls AS (SELECT r, count(*) AS c, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS o FROM run) WHERE o = 1)
SELECT v.doc_id, coalesce(c, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(ls.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM v LEFT JOIN ls USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
