"""The queries of ``plans.queries`` as DuckDB SQL, written from the definitions."""

from __future__ import annotations

from weftgraph.plans.files import STOP

_B = """
ev AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'G' WHEN 'view' THEN 'T' ELSE 'N' END AS base FROM events),
b AS (SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS q, dense_rank() OVER (ORDER BY user_id) AS seq_id, user_id, base FROM ev),
s AS (SELECT seq_id, user_id, 'u' || user_id AS name, min(q) AS seq_offset, count(*) AS seq_len, string_agg(base, '' ORDER BY q) AS seq FROM b GROUP BY seq_id, user_id)"""
_AL = (
    _B
    + """,
al AS (
  SELECT 1 AS kind, a.seq_id AS qi, t.seq_id AS ti, least(a.seq_len, t.seq_len) AS n, 0 AS ts, a.user_id % 3 = 0 AS rev, a.seq_offset AS qo, t.seq_offset AS t_o,
    a.name AS qn, t.name AS tn, a.seq_len AS ql, t.seq_len AS tl FROM s a JOIN s t ON t.seq_id = a.seq_id + 1
  UNION ALL SELECT 2, seq_id, seq_id, seq_len - 2, 2, false, seq_offset, seq_offset, name, name, seq_len, seq_len FROM s WHERE seq_len > 2)"""
)
_RUNS = (
    _AL
    + """,
px AS (SELECT kind, qi, rev, k, CASE WHEN rev THEN qo + n - 1 - k ELSE qo + k END AS q, t_o + ts + k AS t FROM al, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k)),
mt AS (SELECT p.* FROM px p JOIN b x ON x.q = p.q JOIN b y ON y.q = p.t
  WHERE CASE WHEN p.rev THEN translate(x.base, 'ACGT', 'TGCA') ELSE x.base END = y.base AND y.base <> 'N' AND p.q <> p.t),
isl AS (SELECT *, k - row_number() OVER (PARTITION BY kind, qi ORDER BY k) AS island FROM mt),
runs AS (SELECT rev AS is_rev, arg_min(q, k) AS q, min(t) AS t, count(*) AS len FROM isl GROUP BY kind, qi, rev, island)"""
)
_CC = (
    _RUNS
    + """,
e AS (SELECT q AS u, t AS v FROM mt UNION SELECT t, q FROM mt),
cc(q, c) USING KEY (q) AS (SELECT q, q FROM b
  UNION SELECT e.u, min(cc.c) FROM e JOIN cc ON cc.q = e.v JOIN recurring.cc r ON r.q = e.u WHERE cc.c < r.c GROUP BY e.u),
mem AS (SELECT b.q, b.seq_id, b.base, cc.c, h.base AS c_base FROM b JOIN cc ON cc.q = b.q JOIN b h ON h.q = cc.c)"""
)


def _groups(g: str) -> str:
    return f"""{_CC},
num AS (SELECT *, row_number() OVER w AS rn, q - lag(q) OVER w AS gap FROM mem WINDOW w AS (PARTITION BY c, seq_id ORDER BY q)),
grp AS (SELECT *, CAST({g} AS BIGINT) AS g FROM num),
bm AS (SELECT q, seq_id, base, c_base, dense_rank() OVER (ORDER BY c, g) - 1 AS s, base <> c_base AS is_rev FROM grp)"""


_MAP = _groups("0")
_IV = (
    _MAP
    + """,
ch AS (SELECT *, CASE WHEN lag(is_rev) OVER w = is_rev AND s - lag(s) OVER w = CASE WHEN is_rev THEN -1 ELSE 1 END THEN 0 ELSE 1 END AS fresh FROM bm WINDOW w AS (PARTITION BY seq_id ORDER BY q)),
ci AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY q) AS island FROM ch),
iv AS (SELECT seq_id, min(q) AS q_start, max(q) + 1 AS q_end, min(s) AS s_start, max(s) + 1 AS s_end, is_rev FROM ci GROUP BY seq_id, island, is_rev)"""
)
_ND = (
    _IV
    + """,
cut AS (SELECT s_start AS p FROM iv UNION SELECT s_end FROM iv),
sp AS (SELECT row_number() OVER (ORDER BY p) AS node_id, p AS s_start, lead(p) OVER (ORDER BY p) AS s_end FROM cut),
gb AS (SELECT s, min(c_base) AS base FROM bm GROUP BY s),
nd AS (SELECT node_id, s_start, s_end, string_agg(base, '' ORDER BY s) AS seq FROM sp JOIN gb ON s >= s_start AND s < s_end GROUP BY node_id, s_start, s_end),
st AS (SELECT bm.seq_id, bm.q, nd.node_id, bm.is_rev FROM bm JOIN nd ON nd.s_start = bm.s),
lk AS (SELECT node_id AS from_id, is_rev AS from_rev, lead(node_id) OVER w AS to_id, lead(is_rev) OVER w AS to_rev FROM st WINDOW w AS (PARTITION BY seq_id ORDER BY q))"""
)
_R = "WITH RECURSIVE "
_RG = """oa AS (SELECT o_orderkey, o_orderkey * 3 AS s, o_custkey % 9 + 1 AS n FROM orders),
l AS (SELECT o_orderkey AS l_id, s AS l_start, s + n AS l_end FROM oa WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS r_id, s AS r_start, s + n AS r_end, s * 2 + 50 AS pos, o_orderkey % 3 = 0 AS is_rev FROM oa WHERE o_orderkey % 2 = 1)"""
_CG = "c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) || 'M' || l_linenumber || 'I' || l_suppkey || '=' AS text FROM lineitem)"
_SIGN = "CASE WHEN {0} THEN '-' ELSE '+' END"
_U = "18446744073709551615::HUGEINT"
_PAF = f"qn AS query_name, ql AS query_len, CAST(0 AS BIGINT) AS query_start, n AS query_end, {_SIGN.format('rev')} AS strand, tn AS target_name, tl AS target_len, CAST(ts AS BIGINT) AS target_start, ts + n AS target_end"
_PK = "pk AS (SELECT (q << 1) | CAST(is_rev AS BIGINT) AS qp, t << 1 AS tp, len FROM runs)"


def _mix(seed: str, part: str, up: int, down: int) -> str:
    """seed ^ (part + constant + (seed << up) + (seed >> down)) without overflow."""
    return f"xor({seed}, ({part} + 11400714819323198485::HUGEINT + (({seed} * {2**up}::HUGEINT) & {_U}) + ({seed} // {2**down}::HUGEINT)) & {_U})"


_HASH = f"""{_R}{_RUNS}, {_PK},
h0 AS (SELECT *, CAST(qp | tp | len AS HUGEINT) AS h FROM pk),
h1 AS (SELECT qp, tp, len, {_mix("h", "qp", 17, 9)} AS h FROM h0),
h2 AS (SELECT qp, tp, len, {_mix("h", "tp", 7, 23)} AS h FROM h1),
h3 AS (SELECT qp, tp, len, {_mix("h", "len", 9, 2)} AS h FROM h2)"""

ORACLES: dict[str, str] = {
    "sequence_index": f"WITH {_B} SELECT seq_id, name, seq_offset, seq_len FROM s",
    "base_table": f"WITH {_B} SELECT q, seq_id, base FROM b",
    "complement": "SELECT p_partkey, translate(regexp_replace(upper(p_name), '[^ABCDGHKMQRSTUVWY#$\\-]', 'N', 'g'), 'ABCDGHKMQRSTUVWY#$', 'TVGHCDMKQYWAABSR$#') AS complement FROM part",
    "revcomp": f"WITH {_B} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM s",
    "pos_pack_roundtrip": "WITH p AS (SELECT o_orderkey, (o_orderkey << 1) | CAST(o_custkey % 2 AS BIGINT) AS pos FROM orders) SELECT o_orderkey, pos, pos >> 1 AS off, (pos & CAST(1 AS BIGINT)) = 1 AS is_rev, (pos >> 1) || CASE WHEN pos % 2 = 1 THEN '-' ELSE '+' END AS txt FROM p",
    "pos_step": "WITH p AS (SELECT o_orderkey, o_custkey % 2 AS r, (o_orderkey + 10) * 2 + o_custkey % 2 AS pos FROM orders) SELECT o_orderkey, pos + CASE WHEN r = 1 THEN -2 ELSE 2 END AS up, pos + CASE WHEN r = 1 THEN 6 ELSE -6 END AS down, CASE WHEN r = 1 THEN pos - 1 ELSE pos + 1 END AS flip FROM p",
    "pos_in_sequences": f"WITH {_B} SELECT seq_id, seq_offset AS fwd, seq_offset + seq_len - 1 AS rev, substr(seq, 2, 3) AS sub, translate(substr(seq, 1, 1), 'ACGT', 'TGCA') AS base FROM s",
    "cigar_parse": f"WITH {_CG} SELECT l_orderkey, l_linenumber, i - 1 AS op_no, CAST(regexp_extract_all(text, '([0-9]+)([^0-9])', 1)[i] AS BIGINT) AS len, regexp_extract_all(text, '([0-9]+)([^0-9])', 2)[i] AS op FROM c, LATERAL (SELECT unnest(generate_series(1, 3)) AS i)",
    "cigar_format": f"WITH {_CG} SELECT l_orderkey, l_linenumber, text FROM c",
    "handy_numbers": "SELECT p_partkey, p_size || CASE p_partkey % 5 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN 'g' WHEN 3 THEN '' ELSE 'x' END AS txt, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size * 1e3 WHEN 1 THEN p_size * 1e6 WHEN 2 THEN p_size * 1e9 WHEN 3 THEN p_size ELSE -1 END AS DOUBLE) AS value FROM part",
    "tokenize": "WITH t AS (SELECT p_partkey, string_split(p_type, ' ') AS x FROM part) SELECT p_partkey, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS i, unnest(x) AS token FROM t",
    "paf_valid_filter": "WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT l_orderkey, n AS l_linenumber, n - 1 AS query_start, q AS query_end, n * 2 - 2 AS target_start, q - 5 AS target_end FROM p WHERE n - 1 < 40 AND n - 1 < q AND q <= 40 AND n * 2 - 2 < 30 AND n * 2 - 2 < q - 5 AND q - 5 <= 30",
    "paf_round_trip": f"WITH {_AL} SELECT qn AS query_name, ql AS query_len, CAST(0 AS BIGINT) AS query_start, n AS query_end, CASE WHEN rev THEN '-' ELSE '+' END AS strand, tn AS target_name, tl AS target_len, CAST(ts AS BIGINT) AS target_start, ts + n AS target_end, n || 'M' AS cigar FROM al",
    "sxs_records": f"WITH {_AL} SELECT qn || '>' || tn AS rec, concat('A', chr(9), tn, chr(9), qn, chr(10), 'I', chr(9), ts, chr(9), ts + n, chr(9), 0, chr(9), n, chr(10), 'M', chr(9), n, chr(10), 'C', chr(9), n, 'M', chr(10), 'Q', chr(9), 60) AS line FROM al",
    "fasta_records": f"WITH {_B} SELECT seq_id, '>' || name || chr(10) || (SELECT string_agg(substr(seq, CAST(i AS BIGINT), 60), chr(10) ORDER BY i) FROM (SELECT unnest(generate_series(1, seq_len, 60)) AS i)) AS line FROM s",
    "pair_enumeration": "SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey",
    "match_runs": f"{_R}{_RUNS} SELECT is_rev, q, t, len FROM runs",
    "match_runs_min_len": f"{_R}{_RUNS} SELECT is_rev, q, t, len FROM runs WHERE len >= 2",
    "match_both_directions": f'{_R}{_RUNS} SELECT CASE WHEN is_rev THEN q - len + 1 ELSE q END AS start, CASE WHEN is_rev THEN q + 1 ELSE q + len END AS "end", CASE WHEN is_rev THEN t + len - 1 ELSE t END AS pos, is_rev FROM runs UNION ALL SELECT t, t + len, q, is_rev FROM runs',
    "nth_match": f'{_R}{_RUNS}, bd AS (SELECT CASE WHEN is_rev THEN q - len + 1 ELSE q END AS start, CASE WHEN is_rev THEN q + 1 ELSE q + len END AS "end", CASE WHEN is_rev THEN t + len - 1 ELSE t END AS pos, is_rev FROM runs UNION ALL SELECT t, t + len, q, is_rev FROM runs) SELECT row_number() OVER (ORDER BY start, "end", pos, is_rev) - 1 AS n, start, "end", pos, is_rev FROM bd',
    "match_hash": f"{_HASH} SELECT qp, tp, len, CAST(CASE WHEN h > 9223372036854775807 THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS hash FROM h3",
    "match_sparse": f"{_HASH} SELECT qp, tp, len FROM h3 WHERE CAST(h AS FLOAT) < CAST(9223372036854775808 AS FLOAT)",
    "seq_asof_lookup": f"WITH {_B} SELECT e.event_id AS p, s.seq_offset AS start, s.seq_id FROM events e ASOF JOIN s ON e.event_id >= s.seq_offset",
    "interval_overlap_join": f'WITH {_RG} SELECT l_id, r_id, greatest(l_start, r_start) AS start, least(l_end, r_end) AS "end", pos + CASE WHEN is_rev THEN -1 ELSE 1 END * greatest(l_start - r_start, 0) AS pos, is_rev FROM l JOIN r ON l_start < r_end AND r_start < l_end',
    "point_in_interval": f"WITH {_RG} SELECT l_id, l_start AS p, r_id FROM l JOIN r ON r_start <= l_start AND l_start < r_end",
    "connected_components": f"{_R}{_CC} SELECT q, c FROM cc WHERE q IN (SELECT u FROM e)",
    "component_sizes": f"{_R}{_CC} SELECT c, count(*) AS n, min(q) AS low, max(q) AS high FROM cc WHERE q IN (SELECT u FROM e) GROUP BY c",
    "repeat_groups_r1": f"{_R}{_groups('CASE WHEN rn > 1 THEN rn ELSE 0 END')} SELECT q, c, g FROM grp",
    "repeat_groups_l": f"{_R}{_groups('CASE WHEN gap < 4 THEN rn ELSE 0 END')} SELECT q, c, g FROM grp",
    "base_map": f"{_R}{_MAP} SELECT q, seq_id, s, is_rev FROM bm",
    "closure_segments": f"{_R}{_MAP} SELECT q, seq_id, s, is_rev FROM bm",
    "base_map_r2": f"{_R}{_groups('CASE WHEN rn > 2 THEN rn ELSE 0 END')} SELECT q, seq_id, s, is_rev FROM bm",
    "graph_bases": f"{_R}{_MAP} SELECT s, min(c_base) AS base FROM bm GROUP BY s",
    "path_intervals": f"{_R}{_IV} SELECT seq_id, q_start, q_end, s_start, s_end, is_rev FROM iv",
    "node_table": f"{_R}{_ND} SELECT node_id, s_start, s_end, seq FROM nd",
    "path_steps": f"{_R}{_ND} SELECT seq_id, q, node_id, is_rev FROM st",
    "links": f"{_R}{_ND} SELECT DISTINCT from_id, from_rev, to_id, to_rev FROM lk WHERE to_id IS NOT NULL",
    "link_frequency": f"{_R}{_ND} SELECT from_id, from_rev, to_id, to_rev, count(*) AS n FROM lk WHERE to_id IS NOT NULL GROUP BY ALL",
    "gfa_lines": f"""{_R}{_ND} SELECT 'H' || chr(9) || 'VN:Z:1.0' AS line
UNION ALL SELECT concat('S', chr(9), node_id, chr(9), seq) FROM nd
UNION ALL SELECT DISTINCT concat('L', chr(9), from_id, chr(9), {_SIGN.format("from_rev")}, chr(9), to_id, chr(9), {_SIGN.format("to_rev")}, chr(9), '0M') FROM lk WHERE to_id IS NOT NULL
UNION ALL SELECT concat('P', chr(9), name, chr(9), string_agg(node_id || {_SIGN.format("is_rev")}, ',' ORDER BY q), chr(9), '*') FROM st JOIN s USING (seq_id) GROUP BY name""",
    "scaffold_lines": f"""{_R}{_ND} SELECT concat('S', chr(9), length(seq), chr(9), seq) AS line FROM nd
UNION ALL SELECT DISTINCT concat('J', chr(9), from_id, chr(9), to_id, chr(9), CASE WHEN from_rev THEN 's' ELSE 'e' END, chr(9), CASE WHEN to_rev THEN 'e' ELSE 's' END) FROM lk WHERE to_id IS NOT NULL
UNION ALL SELECT concat('A', chr(9), node_id, chr(9), name, chr(10), 'I', chr(9), 0, chr(9), n, chr(9), CASE WHEN is_rev THEN a + n ELSE a END, chr(9), CASE WHEN is_rev THEN a ELSE a + n END) FROM (
  SELECT st.node_id, name, st.is_rev, s_end - s_start AS n, CAST(coalesce(sum(s_end - s_start) OVER (PARTITION BY seq_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM st JOIN nd USING (node_id) JOIN s USING (seq_id))""",
    "validate_paths": f"{_R}{_IV} SELECT s.seq_id, s.seq_len, CAST(sum(q_end - q_start) AS BIGINT) AS spelled, CAST(0 AS BIGINT) AS faults FROM s JOIN iv USING (seq_id) GROUP BY s.seq_id, s.seq_len",
} | {
    "fasta_scan": f"WITH {_B} SELECT seq_id - 1 AS rec_no, CASE WHEN seq_id % 3 = 0 THEN '>' ELSE '' END || name AS name, seq FROM s",
    "fastq_scan": f"WITH {_B} SELECT seq_id - 1 AS rec_no, CASE WHEN seq_id % 3 = 0 THEN '>' ELSE '' END || name AS name, seq FROM s",
    "gzip_scan": f"WITH {_B} SELECT seq_id - 1 AS rec_no, name, seq FROM s",
    "format_sniff": "SELECT * FROM (VALUES (0, 'fasta'), (1, 'fastq')) t(n, kind)",
    "paf_list_scan": f"WITH {_AL} SELECT {_PAF}, CAST(CASE WHEN kind = 1 THEN 3 ELSE 0 END AS BIGINT) AS min_match_len FROM al",
    "paf_stop": f"WITH {_AL} SELECT {_PAF} FROM al ORDER BY qi, kind LIMIT {STOP}",
    "paf_skip": f"WITH {_AL} SELECT {_PAF} FROM al",
    "sxs_scan": f"WITH {_AL} SELECT qn AS query_name, tn AS target_name, CAST(0 AS BIGINT) AS query_start, n AS query_end, CAST(ts AS BIGINT) AS target_start, ts + n AS target_end, n AS num_matches, n AS len, 'M' AS op, 60 AS mapq FROM al",
    "gfa_file": f"""{_R}{_ND}, li AS (SELECT 0 AS kind, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 'H' || chr(9) || 'VN:Z:1.0' AS line
UNION ALL SELECT 1, node_id, 0, 0, 0, concat('S', chr(9), node_id, chr(9), seq) FROM nd
UNION ALL SELECT DISTINCT 2, from_id, CAST(from_rev AS INT), to_id, CAST(to_rev AS INT), concat('L', chr(9), from_id, chr(9), {_SIGN.format("from_rev")}, chr(9), to_id, chr(9), {_SIGN.format("to_rev")}, chr(9), '0M') FROM lk WHERE to_id IS NOT NULL
UNION ALL SELECT 3, seq_id, 0, 0, 0, concat('P', chr(9), name, chr(9), string_agg(node_id || {_SIGN.format("is_rev")}, ',' ORDER BY q), chr(9), '*') FROM st JOIN s USING (seq_id) GROUP BY seq_id, name)
SELECT row_number() OVER (ORDER BY kind, a, b, c, d) - 1 AS n, line FROM li""",
    "scaffold_files": f"""{_R}{_ND},
j AS (SELECT DISTINCT from_id, to_id, concat('J', chr(9), from_id, chr(9), to_id, chr(9), CASE WHEN from_rev THEN 's' ELSE 'e' END, chr(9), CASE WHEN to_rev THEN 'e' ELSE 's' END) AS line, from_rev, to_rev FROM lk WHERE to_id IS NOT NULL),
x AS (SELECT st.node_id, name, st.is_rev, q, s_end - s_start AS n, CAST(coalesce(sum(s_end - s_start) OVER (PARTITION BY seq_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM st JOIN nd USING (node_id) JOIN s USING (seq_id)),
y AS (SELECT 2 * q AS k, concat('A', chr(9), node_id, chr(9), name) AS line FROM x UNION ALL SELECT 2 * q + 1, concat('I', chr(9), 0, chr(9), n, chr(9), CASE WHEN is_rev THEN a + n ELSE a END, chr(9), CASE WHEN is_rev THEN a ELSE a + n END) FROM x)
SELECT 'seq' AS kind, row_number() OVER (ORDER BY node_id) - 1 AS n, concat('S', chr(9), length(seq), chr(9), seq) AS line FROM nd
UNION ALL SELECT 'scf', row_number() OVER (ORDER BY from_id, to_id, line) - 1, line FROM j
UNION ALL SELECT 'sxs', row_number() OVER (ORDER BY k) - 1, line FROM y""",
    "index_round_trip": f"WITH {_B} SELECT seq_id, name, seq_offset, seq_len FROM s",
    "duplicate_names": "SELECT 'n' || c_nationkey AS name, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1",
    "part_sequences": """WITH p AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS seq FROM part WHERE p_partkey % 7 <> 0 AND length(replace(p_name, ' ', '')) > 0)
SELECT row_number() OVER w AS seq_id, 'p' || p_partkey AS name, CAST(coalesce(sum(length(seq)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq_offset, length(seq) AS seq_len, seq FROM p WINDOW w AS (ORDER BY p_partkey)""",
    "header_names": "SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part",
    "integer_hashes": f"""WITH k0 AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000003 AS x FROM orders),
k1 AS (SELECT o_orderkey, ({_U} - x + x * 2097152) & {_U} AS x FROM k0), k2 AS (SELECT o_orderkey, xor(x, x // 16777216) AS x FROM k1),
k3 AS (SELECT o_orderkey, (x * 265) & {_U} AS x FROM k2), k4 AS (SELECT o_orderkey, xor(x, x // 16384) AS x FROM k3),
k5 AS (SELECT o_orderkey, (x * 21) & {_U} AS x FROM k4), k6 AS (SELECT o_orderkey, xor(x, x // 268435456) AS x FROM k5),
k7 AS (SELECT o_orderkey, (x + x * 2147483648) & {_U} AS x FROM k6)
SELECT o_orderkey, CAST(CASE WHEN x > 9223372036854775807 THEN x - 18446744073709551616::HUGEINT ELSE x END AS BIGINT) AS hash FROM k7""",
    "map_fault_counts": f"WITH {_B} SELECT q, CAST(2 AS BIGINT) AS n FROM b WHERE q % 10 = 0",
    "pair_one_vs_rest": "SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey",
}
