"""DuckDB SQL of media_queries, from the definitions, over single samples; constants are written out here."""

from __future__ import annotations

from framelake.plans.oracles import BYTES, FRAMES, INDEX, OFFSETS, SAMPLES, TELEMETRY, _div_round, _vsize, _zig

_step78 = "greatest(1, (5 * 8 * (16 + 2 * (u + v) + CASE WHEN u + v >= 8 THEN 4 ELSE 0 END) + 8) // 16)"
_even = "(x - (x & 1))"

SIGNS = """
seq AS (SELECT unnest([0, 4, 6, 2, 3, 7, 5, 1]) AS nat, generate_subscripts([0, 4, 6, 2, 3, 7, 5, 1], 1) - 1 AS u),
h AS (SELECT u, k, CASE WHEN bit_count(CAST(nat & k AS INTEGER)) % 2 = 0 THEN 1 ELSE -1 END AS s FROM seq, (SELECT CAST(range AS INTEGER) AS k FROM range(8))),
sg AS (SELECT a.u AS u, b.u AS v, a.k AS sx, b.k AS sy, a.s * b.s AS s, row_number() OVER (PARTITION BY a.k, b.k ORDER BY a.u + b.u, CASE WHEN (a.u + b.u) % 2 = 0 THEN a.u ELSE b.u END) - 1 AS pos FROM h a, h b)"""

PICTURES = (
    FRAMES
    + """,
pb AS (SELECT stream, frame_no, i, greatest(0, least(255, x + 128)) AS x, greatest(0, least(255, p + 128)) AS p FROM pr)"""
)

COSTS = f"""{PICTURES}, {SIGNS},
cand(ord, dx, dy) AS (VALUES (0, 0, 0), (1, 2, 0), (2, -2, 0), (3, 0, 2), (4, 0, -2), (5, 2, 2), (6, 2, -2), (7, -2, 2), (8, -2, -2)),
res AS (SELECT a.stream, a.frame_no, ord, dx, dy, a.i, a.x, b.x AS p, a.x - b.x AS r FROM pb a CROSS JOIN cand JOIN pb b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1
  AND b.i = greatest(0, least(7, a.i // 8 + dy)) * 8 + greatest(0, least(7, a.i % 8 + dx))),
co AS (SELECT stream, frame_no, ord, u, v, any_value(pos) AS pos, CAST(sum(r * s) AS BIGINT) AS c FROM res JOIN sg ON i = sy * 8 + sx GROUP BY stream, frame_no, ord, u, v),
q AS (SELECT *, {_step78} AS step, CAST({_div_round("c", _step78)} AS BIGINT) AS q FROM co),
nz AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY stream, frame_no, ord ORDER BY pos), -1) - 1 AS run FROM q WHERE q <> 0),
bt AS (SELECT stream, frame_no, ord, CAST(1 + sum(CASE WHEN run < 8 AND {_zig("q")} <= 16 THEN 1 ELSE 1 + {_vsize("run")} + {_vsize(_zig("q"))} END) AS BIGINT) AS bytes FROM nz GROUP BY ALL),
bk AS (SELECT stream, frame_no, ord, sy * 8 + sx AS i, CAST(sum(q * step * s) AS BIGINT) AS y FROM q JOIN sg USING (u, v) GROUP BY ALL),
di AS (SELECT r.stream, r.frame_no, r.ord, CAST(sum(power(r.x - greatest(0, least(255, r.p + {_div_round("y", "64")})), 2)) AS BIGINT) AS distortion FROM res r JOIN bk USING (stream, frame_no, ord, i) GROUP BY ALL),
sa AS (SELECT stream, frame_no, ord, dx, dy, CAST(sum(abs(r)) FILTER (i % 2 = 0 AND (i // 8) % 2 = 0) AS BIGINT) AS difference FROM res GROUP BY ALL),
al AS (SELECT stream, frame_no, ord, dx, dy, difference, coalesce(bytes, 0) AS bytes, distortion FROM sa JOIN di USING (stream, frame_no, ord) LEFT JOIN bt USING (stream, frame_no, ord))"""


def _sheets(stride: int) -> str:
    return f"""
ei AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, greatest(0, least(255, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 32) AS INTEGER) + 128)) AS v FROM embeddings),
sh AS (SELECT sheet FROM (SELECT unnest(range(0, (SELECT max(vec_id) // {stride} + 1 FROM embeddings))) AS sheet) s JOIN embeddings e ON e.vec_id >= sheet * {stride} AND e.vec_id < sheet * {stride} + 64 GROUP BY sheet HAVING count(*) = 64),
px AS (SELECT sheet, ((vec_id - sheet * {stride}) % 8) * 8 + i % 8 AS x, ((vec_id - sheet * {stride}) // 8) * 8 + i // 8 AS y, v FROM ei JOIN sh ON vec_id >= sheet * {stride} AND vec_id < sheet * {stride} + 64)"""


_refined = """
  SELECT s.sheet, s.dx, s.dy FROM {t} t JOIN sc s ON s.sheet = t.sheet AND abs(s.dx - t.dx) <= 1 AND abs(s.dy - t.dy) <= 1
  QUALIFY row_number() OVER (PARTITION BY s.sheet ORDER BY s.sad, CASE WHEN s.dx = t.dx AND s.dy = t.dy THEN 0 ELSE 1 END, s.dy, s.dx) = 1"""

FAULTS = """
rc AS (SELECT stream, frame_no, CASE WHEN event_id % 211 = 0 THEN 3 ELSE frame_type END AS frame_type, CASE WHEN event_id % 233 = 0 THEN 536870913 ELSE packed_size END AS packed_size,
  CASE WHEN event_id % 229 = 0 THEN 'no record mark' WHEN event_id % 211 = 0 THEN 'bad frame type' WHEN event_id % 223 = 0 THEN 'unknown generation' WHEN event_id % 227 = 0 THEN 'number out of sequence'
    WHEN event_id % 233 = 0 THEN 'payload too large' WHEN event_id % 239 = 0 THEN 'past the end of the file' END AS fault FROM ix)"""

ORACLES: dict[str, str] = {
    "motion_candidates": f"""WITH p AS (SELECT p_partkey, p_size % 13 // 2 * 2 AS r, p_partkey % 9 - 4 AS hx, p_partkey // 9 % 9 - 4 AS hy FROM part),
t AS (SELECT p_partkey, r, 0 AS k, 0 AS x, 0 AS y FROM p
  UNION ALL SELECT p_partkey, r, d * 4 + j, hx + CASE j WHEN 0 THEN 2 * d WHEN 1 THEN -2 * d ELSE 0 END, hy + CASE j WHEN 2 THEN 2 * d WHEN 3 THEN -2 * d ELSE 0 END FROM p, (SELECT unnest(range(1, 7)) AS d), (SELECT unnest(range(4)) AS j) WHERE 2 * d <= r
  UNION ALL SELECT p_partkey, r, 100 + j, CASE WHEN j < 2 THEN 2 ELSE -2 END, CASE WHEN j % 2 = 0 THEN 2 ELSE -2 END FROM p, (SELECT unnest(range(4)) AS j) WHERE r >= 2),
c AS (SELECT p_partkey, k, greatest(-r, least(r, x)) AS x, greatest(-r, least(r, y)) AS y FROM t),
e AS (SELECT p_partkey, {_even} AS dx, {_even.replace("x", "y")} AS dy, min(k) AS k FROM c GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INTEGER) AS ord, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) <= 32""",
    "shortlist_unique": "SELECT l_orderkey AS block, CAST(l_partkey % 3 - 1 AS INTEGER) AS dx, CAST(l_suppkey % 2 AS INTEGER) AS dy, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3",
    "motion_block_cost": f"WITH {COSTS} SELECT stream, frame_no, ord, dx, dy, difference, bytes, distortion FROM al",
    "motion_search": f"""WITH {COSTS},
rk AS (SELECT *, CASE WHEN ord = 0 THEN 0 ELSE row_number() OVER (PARTITION BY stream, frame_no, ord = 0 ORDER BY difference, ord) END AS place FROM al),
ct AS (SELECT *, distortion + bytes + CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 1 + {_vsize(_zig("dx"))} + {_vsize(_zig("dy"))} END AS cost FROM rk WHERE place <= 2)
SELECT stream, frame_no, dx, dy, CAST(cost AS BIGINT) AS cost FROM ct QUALIFY row_number() OVER (PARTITION BY stream, frame_no ORDER BY cost, place) = 1""",
    "global_motion": f"""WITH {_sheets(8)},
g AS (SELECT unnest([10, 20, 30, 40, 50]) AS y), o AS (SELECT dx, dy FROM (SELECT unnest(range(-8, 9)) AS dx), (SELECT unnest(range(-8, 9)) AS dy)),
cu AS (SELECT sheet, px.x, px.y, v FROM px JOIN g ON g.y = px.y JOIN g h ON h.y = px.x),
sc AS (SELECT cu.sheet, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, sum(abs(cu.v - b.v)) AS sad FROM cu CROSS JOIN o JOIN px b ON b.sheet = cu.sheet - 1 AND b.x = cu.x - dx AND b.y = cu.y - dy GROUP BY ALL),
z AS (SELECT sheet, sad AS zero FROM sc WHERE dx = 0 AND dy = 0),
c1 AS (SELECT * FROM sc WHERE (dx + 8) % 2 = 0 AND (dy + 8) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sad, dy, dx) = 1),
c2 AS (SELECT * FROM sc WHERE (dx + 8) % 2 = 0 AND (dy + 8) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sad, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END, dy, dx) = 1),
lo AS (SELECT * FROM sc WHERE abs(dx) <= 2 AND abs(dy) <= 2 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sad, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END, dy, dx) = 1),
c3 AS (SELECT * FROM sc WHERE (abs(dx) <= 2 AND abs(dy) <= 2) OR ((dx + 8) % 4 = 0 AND (dy + 8) % 4 = 0)
  QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sad, CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN abs(dx) <= 2 AND abs(dy) <= 2 THEN 1 ELSE 2 END, dy, dx) = 1),
r1 AS ({_refined.format(t="c1")}), r2 AS ({_refined.format(t="c2")}), r3 AS ({_refined.format(t="c3")})
SELECT sheet, 'plain' AS form, dx, dy FROM r1
UNION ALL SELECT sheet, 'guarded', CASE WHEN zero / 25.0::DOUBLE <= 0.5 THEN 0 ELSE dx END, CASE WHEN zero / 25.0::DOUBLE <= 0.5 THEN 0 ELSE dy END FROM r2 JOIN z USING (sheet)
UNION ALL SELECT sheet, 'hinted', CASE WHEN zero / 25.0::DOUBLE <= 0.5 THEN 0 WHEN lo.sad / 25.0::DOUBLE <= 4 OR lo.sad / 25.0::DOUBLE <= zero / 25.0::DOUBLE * 0.9::DOUBLE THEN lo.dx ELSE r3.dx END,
  CASE WHEN zero / 25.0::DOUBLE <= 0.5 THEN 0 WHEN lo.sad / 25.0::DOUBLE <= 4 OR lo.sad / 25.0::DOUBLE <= zero / 25.0::DOUBLE * 0.9::DOUBLE THEN lo.dy ELSE r3.dy END FROM r3 JOIN z USING (sheet) JOIN lo USING (sheet)""",
    "block_motion_wide": f"""WITH {FRAMES},
o AS (SELECT dx, dy FROM (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy)),
sc AS (SELECT a.stream, a.frame_no, dx, dy, CAST((sum(abs(a.x - b.x)) * 256) // 16 + 24 * (abs(dx) + abs(dy)) AS BIGINT) AS cost FROM f a CROSS JOIN o JOIN f b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1
  AND b.i = greatest(0, least(7, a.i // 8 - dy)) * 8 + greatest(0, least(7, a.i % 8 - dx)) WHERE a.i % 2 = 0 AND (a.i // 8) % 2 = 0 GROUP BY a.stream, a.frame_no, dx, dy),
z AS (SELECT stream, frame_no, cost AS zero FROM sc WHERE dx = 0 AND dy = 0),
c AS (SELECT * FROM sc WHERE dx % 2 = 0 AND dy % 2 = 0 AND (dx <> 0 OR dy <> 0) QUALIFY row_number() OVER (PARTITION BY stream, frame_no ORDER BY cost, dy, dx) = 1),
m AS (SELECT c.*, zero, CASE WHEN cost < zero THEN dx ELSE 0 END AS mx, CASE WHEN cost < zero THEN dy ELSE 0 END AS my FROM c JOIN z USING (stream, frame_no)),
t AS (SELECT m.stream, m.frame_no, m.zero, s.dx, s.dy, s.cost, CASE WHEN s.dx = m.dx AND s.dy = m.dy THEN 0 ELSE 1 END AS late FROM m JOIN sc s ON s.stream = m.stream AND s.frame_no = m.frame_no
  AND ((s.dx = m.dx AND s.dy = m.dy) OR (abs(s.dx - mx) <= 1 AND abs(s.dy - my) <= 1 AND (s.dx <> 0 OR s.dy <> 0))))
SELECT stream, frame_no, zero AS zero_score, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, cost AS score, zero > 256 AND cost + 384 < zero AND cost * 100 < zero * 72 AS accepted
FROM t QUALIFY row_number() OVER (PARTITION BY stream, frame_no ORDER BY cost, late, dy, dx) = 1""",
    "cell_prediction": f"""WITH {PICTURES},
v AS (SELECT stream, frame_no, i, x, (i // 8 // 4) * 2 + i % 8 // 4 AS c FROM pb WHERE p IS NOT NULL),
w AS (SELECT *, (frame_no + c) % 5 - 2 AS dx, (frame_no * 3 + c) % 5 - 2 AS dy FROM v),
g AS (SELECT w.stream, w.frame_no, w.i, w.x, b.x AS g FROM w JOIN pb b ON b.stream = w.stream AND b.frame_no = w.frame_no - 1 AND b.i = greatest(0, least(7, w.i // 8 - dy)) * 8 + greatest(0, least(7, w.i % 8 - dx)))
SELECT stream, frame_no, CAST(sum(abs(x - g)) AS BIGINT) AS difference, string_agg(CAST(g AS VARCHAR), ' ' ORDER BY i) AS guess FROM g GROUP BY 1, 2""",
    "intra_choice": f"""WITH {_sheets(64)}, {SIGNS},
b AS (SELECT sheet, x // 8 AS bx, y // 8 AS yy, x % 8 AS lx, y % 8 AS ly, v FROM px),
tp AS (SELECT b.sheet, b.bx, b.yy + 1 AS yy, lx, v FROM b WHERE ly = 7), lf AS (SELECT sheet, bx + 1 AS bx, yy, ly, v FROM b WHERE lx = 7),
ed AS (SELECT sheet, bx, yy, sum(v) AS s, count(*) AS n FROM (SELECT sheet, bx, yy, v FROM tp UNION ALL SELECT sheet, bx, yy, v FROM lf) GROUP BY ALL),
pd AS (SELECT b.*, CAST(CASE WHEN ed.n IS NULL THEN 128 ELSE (ed.s + ed.n // 2) // ed.n END AS INTEGER) AS mean, coalesce(tp.v, 128) AS up, coalesce(lf.v, 128) AS side
  FROM b LEFT JOIN ed USING (sheet, bx, yy) LEFT JOIN tp ON tp.sheet = b.sheet AND tp.bx = b.bx AND tp.yy = b.yy AND tp.lx = b.lx LEFT JOIN lf ON lf.sheet = b.sheet AND lf.bx = b.bx AND lf.yy = b.yy AND lf.ly = b.ly),
md AS (SELECT sheet, bx, yy, lx, ly, mean, 1 AS mode, v - mean AS r FROM pd UNION ALL SELECT sheet, bx, yy, lx, ly, mean, 2, v - up FROM pd UNION ALL SELECT sheet, bx, yy, lx, ly, mean, 3, v - side FROM pd),
co AS (SELECT sheet, bx, yy, mode, any_value(mean) AS mean, u, v, any_value(pos) AS pos, CAST(sum(r * s) AS BIGINT) AS c FROM md JOIN sg ON sx = lx AND sy = ly GROUP BY sheet, bx, yy, mode, u, v),
q AS (SELECT *, CAST({_div_round("c", _step78)} AS BIGINT) AS q FROM co),
nz AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY sheet, bx, yy, mode ORDER BY pos), -1) - 1 AS run FROM q WHERE q <> 0),
sz AS (SELECT sheet, bx, yy, mode, 1 + sum({_vsize("run")} + {_vsize(_zig("q"))}) AS bytes FROM nz GROUP BY ALL),
al AS (SELECT m.*, coalesce(bytes, 0) AS bytes FROM (SELECT DISTINCT sheet, bx, yy, mode, mean FROM co) m LEFT JOIN sz USING (sheet, bx, yy, mode))
SELECT sheet, CAST(bx AS INTEGER) AS block_x, CAST(yy AS INTEGER) AS block_y, mean, mode, CAST(bytes AS INTEGER) AS bytes FROM al QUALIFY row_number() OVER (PARTITION BY sheet, bx, yy ORDER BY bytes, mode) = 1""",
    "intra_waves": """WITH p AS (SELECT p_partkey, (p_size + 7) // 8 AS nx, (p_partkey % 70 + 8) // 8 AS ny FROM part),
b AS (SELECT p_partkey, x, y FROM (SELECT p_partkey, ny, unnest(range(nx)) AS x FROM p), LATERAL (SELECT unnest(range(ny)) AS y))
SELECT p_partkey, CAST(x + y AS INTEGER) AS wave, count(*) AS blocks FROM b GROUP BY 1, 2""",
    "raster_order": """WITH p AS (SELECT p_partkey, (p_size + 7) // 2 * 2 AS w, (p_partkey % 23 + 4) // 2 * 2 AS h FROM part),
g AS (SELECT p_partkey, 0 AS plane, (w + 7) // 8 AS nx, (h + 7) // 8 AS ny FROM p UNION ALL SELECT p_partkey, c, (w // 2 + 7) // 8, (h // 2 + 7) // 8 FROM p, (SELECT unnest([1, 2]) AS c)),
b AS (SELECT p_partkey, plane, yy, bx FROM (SELECT p_partkey, plane, ny, unnest(range(nx)) AS bx FROM g), LATERAL (SELECT unnest(range(ny)) AS yy))
SELECT p_partkey, plane, yy AS block_y, bx AS block_x, row_number() OVER (PARTITION BY p_partkey ORDER BY plane, yy, bx) - 1 AS place FROM b""",
    "picture_compare": f"""WITH {SAMPLES}, {SIGNS},
c AS (SELECT label, vec_id, u, v, CAST(sum(x * sg.s) AS BIGINT) AS c FROM s JOIN sg ON i = sy * 8 + sx GROUP BY label, vec_id, u, v),
q AS (SELECT *, {_step78} AS step, CAST({_div_round("c", _step78)} AS BIGINT) AS q FROM c),
y AS (SELECT vec_id, sy * 8 + sx AS i, CAST(sum(q * step * sg.s) AS BIGINT) AS y FROM q JOIN sg USING (u, v) GROUP BY ALL),
e AS (SELECT s.label AS stream, count(*) AS samples, CAST(sum(power(x - {_div_round("y", "64")}, 2)) AS BIGINT) AS sse FROM s JOIN y USING (vec_id, i) WHERE vec_id % 7 <> 0 AND (vec_id % 5 <> 0 OR i < 48) GROUP BY 1)
SELECT stream, sse, samples, CAST(sse AS DOUBLE) / samples AS mse, CASE WHEN sse = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / (CAST(sse AS DOUBLE) / samples)) END AS psnr_db FROM e""",
    "row_delta": f"""WITH {SAMPLES}, b AS (SELECT vec_id, i, greatest(0, least(255, x + 128)) AS x FROM s),
d AS (SELECT vec_id, i, (x - coalesce(lag(x) OVER (PARTITION BY vec_id, i // 8 ORDER BY i), 0) + 256) % 256 AS d FROM b)
SELECT vec_id, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY i) AS delta FROM d GROUP BY 1""",
    "row_restore": f"WITH {SAMPLES} SELECT vec_id, string_agg(CAST(greatest(0, least(255, x + 128)) AS VARCHAR), ' ' ORDER BY i) AS restored FROM s GROUP BY 1",
    "stream_delta": f"""WITH {BYTES}, d AS (SELECT doc_id, block, i, (v - coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY block, i), 0) + 256) % 256 AS d FROM byt)
SELECT doc_id, block, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY i) AS delta FROM d GROUP BY 1, 2""",
    "stream_restore": f"WITH {BYTES} SELECT doc_id, block, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS bytes FROM byt GROUP BY 1, 2",
    "zero_run_cost": f"""WITH {SAMPLES}, {SIGNS},
c AS (SELECT vec_id, u, v, any_value(pos) AS pos, CAST(sum(x * sg.s) AS BIGINT) AS c FROM s JOIN sg ON i = sy * 8 + sx GROUP BY vec_id, u, v),
st AS (SELECT *, greatest(1, (b * 8 * (16 + 2 * (u + v) + CASE WHEN u + v >= 8 THEN 4 ELSE 0 END) + 8) // 16) AS step FROM c, (VALUES (60, 13), (78, 5)) t(quality, b)),
q AS (SELECT vec_id, quality, pos, {_div_round("c", "step")} = 0 AS z FROM st),
n AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id, quality, z ORDER BY pos) AS g FROM q),
r AS (SELECT vec_id, quality, z, min(pos) AS a, count(*) AS n FROM n GROUP BY vec_id, quality, z, g),
k AS (SELECT *, z AND n >= 3 AS fold FROM r),
l AS (SELECT *, CASE WHEN NOT fold AND coalesce(lag(fold) OVER (PARTITION BY vec_id, quality ORDER BY a), true) THEN 1 ELSE 0 END AS opens FROM k)
SELECT vec_id, quality, CAST(sum(CASE WHEN fold THEN 1 ELSE n + opens END) AS BIGINT) AS bytes FROM l GROUP BY 1, 2""",
    "vector_runs": f"""WITH {INDEX}, v AS (SELECT stream, frame_no, (frame_type - 1) || ',' || (packed_size % 2) AS v FROM ix),
i AS (SELECT *, frame_no - row_number() OVER (PARTITION BY stream, v ORDER BY frame_no) AS g FROM v),
r AS (SELECT stream, (count(*) + 255) // 256 AS runs, count(*) AS n FROM i GROUP BY stream, v, g),
t AS (SELECT stream, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(n) AS BIGINT) AS vectors FROM r GROUP BY 1)
SELECT stream, runs, vectors, least(vectors * 2, runs * 3) AS bytes, runs * 3 < vectors * 2 AS folded FROM t""",
    "frame_range": f"WITH {INDEX} SELECT stream, frame_no, frame_type FROM ix WHERE frame_no >= 10 AND frame_no < 30",
    "record_faults": f"WITH {INDEX}, {FAULTS} SELECT stream, frame_no, fault FROM rc WHERE fault IS NOT NULL",
    "repaired_prefix": f"""WITH {INDEX}, {FAULTS},
g AS (SELECT * FROM rc r WHERE NOT EXISTS (SELECT 1 FROM rc b WHERE b.stream = r.stream AND b.frame_no <= r.frame_no AND b.fault IS NOT NULL))
SELECT stream, frame_no, frame_type, CAST(coalesce(sum(packed_size + 32) OVER (PARTITION BY stream ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 96 AS BIGINT) AS record_offset FROM g""",
    "header_fields": """WITH p AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS n, CAST(p_size AS BIGINT) AS z FROM part),
v AS (SELECT p_partkey, n, [[0, 1], [9, 1], [CASE WHEN n % 11 = 0 THEN 95 ELSE 96 END, 2], [n % 2, 4], [z * 2 + n % 13 % 2, 4], [z * 4, 4], [30000, 4], [CASE WHEN n % 17 = 0 THEN 0 ELSE 1001 END, 4], [n, 4], [120, 4], [z, 4], [0, 4], [0, 2], [0, 2], [0, 8], [96, 8], [0, 8],
  [n * 1000003 + 96, 8], [n * 1001000000 // 30000, 8]] AS f FROM p),
h AS (SELECT *, array_to_string(list_transform(f, lambda e: array_to_string(list_transform(list_reverse(range(e[2])), lambda k: substr(printf('%016x', e[1]), CAST(17 - 2 * e[2] + 2 * k AS BIGINT), 2)), '')), '') || '0000000000000000' AS body FROM v)
SELECT p_partkey, CASE WHEN n % 5 = 0 THEN '47564944' || body WHEN n % 7 = 0 THEN substr('47485631' || body, 1, 180) ELSE '47485631' || body END AS bytes,
  f[2][1] AS minor, f[3][1] AS header_size, f[4][1] AS flags, f[5][1] AS width, f[6][1] AS height, f[7][1] AS fps_num, f[8][1] AS fps_den, f[9][1] AS frame_count, f[11][1] AS quality, f[18][1] AS index_offset,
  f[19][1] AS duration_us,
  CASE WHEN n % 5 = 0 THEN 'retired container' WHEN n % 7 = 0 THEN 'no container' WHEN n % 11 = 0 THEN 'bad header size' WHEN (n % 13) % 2 = 1 OR n % 17 = 0 THEN 'bad picture size or rate' END AS fault FROM h""",
    "index_entries": f"""WITH {INDEX}, {OFFSETS}, o AS (SELECT stream, frame_no, record_offset, frame_type FROM of WHERE frame_no < 200),
e AS (SELECT *, array_to_string(list_transform(list_reverse(range(8)), lambda k: substr(printf('%016x', record_offset), CAST(1 + 2 * k AS BIGINT), 2)), '') || printf('%02x', frame_type) || '00000000000000' AS b FROM o),
a AS (SELECT stream, '494e4458' || array_to_string(list_transform(list_reverse(range(4)), lambda k: substr(printf('%08x', any_value(n)), CAST(1 + 2 * k AS BIGINT), 2)), '') || string_agg(b, '' ORDER BY frame_no) AS d FROM (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM e) GROUP BY stream)
SELECT stream, md5(unhex(d)) AS md5, frame_no, record_offset AS "offset", frame_type FROM o JOIN a USING (stream)""",
    "audio_parameters": """SELECT p_partkey, CASE WHEN p_partkey % 4 NOT IN (1, 2) THEN 'channels' WHEN p_partkey % 3 = 0 THEN 'bits' WHEN p_size * 25 > 1024 THEN 'block' WHEN p_partkey % 50 = 0 THEN 'rate' END AS fault FROM part""",
    "rate_texts": """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS n, CAST(p_size AS BIGINT) AS z, length(CAST(p_partkey AS VARCHAR)) AS d FROM part),
r AS (SELECT n, 0 AS form, n * 1000 AS a, z AS b FROM t UNION ALL SELECT n, 1, z * CAST(power(10, d) AS BIGINT) + n, CAST(power(10, d) AS BIGINT) FROM t UNION ALL SELECT n, 2, n, 1 FROM t UNION ALL SELECT n, 3, 0, 1 FROM t
  UNION ALL SELECT n, 4, 0, 1 FROM t UNION ALL SELECT n, 5, n, 1001 FROM t UNION ALL SELECT n, 6, 0, 1 FROM t UNION ALL SELECT n, 7, 2997, 100 FROM t)
SELECT n AS p_partkey, form, CAST(CASE WHEN a > 0 THEN a // gcd(a, b) ELSE 30 END AS BIGINT) AS num, CAST(CASE WHEN a > 0 THEN b // gcd(a, b) ELSE 1 END AS BIGINT) AS den FROM r""",
    "progress_lines": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '7' END AS frame, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS total, CASE WHEN event_id % 3 <> 0 THEN 'a=b' END AS note FROM events""",
    "player_lines": """WITH e AS (SELECT event_id, event_id % 4 AS k, event_id % 500 + CASE WHEN event_id % 4 = 0 THEN 0.25::DOUBLE ELSE 0.5 END AS c, CAST((event_id % 1000) / 1000.0 AS DOUBLE) * CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END AS d FROM events)
SELECT event_id, CASE WHEN k < 2 THEN c END AS audio_clock, CASE WHEN k < 2 THEN d END AS drift, CASE WHEN k < 2 THEN CAST(event_id % 9 AS INTEGER) END AS dropped, CASE WHEN k < 2 THEN CAST(event_id % 300 AS INTEGER) END AS audio_queue_kb,
  CASE k WHEN 0 THEN 0 WHEN 1 THEN CAST(event_id % 77 AS INTEGER) END AS video_queue_kb, CASE k WHEN 0 THEN 'M-V' WHEN 1 THEN 'A-V' END AS kind, CASE WHEN k < 2 THEN round(c - d, 6) END AS video_clock FROM e""",
    "profile_sums": """SELECT event_type, counter, sum(value) AS value FROM (SELECT event_type, 'motion_ms' AS counter, event_id % 100 + 0.5::DOUBLE AS value FROM events
  UNION ALL SELECT event_type, 'rd_ms', CAST(event_id % 7 AS DOUBLE) FROM events UNION ALL SELECT event_type, 'blocks', CAST(user_id % 50 AS DOUBLE) FROM events) GROUP BY 1, 2""",
    "report_ratios": """WITH p AS (SELECT p_partkey, CAST(p_size % 10 * 1000 AS DOUBLE) AS a, CAST(p_partkey * 100 AS DOUBLE) AS b, CAST(p_size % 4 AS DOUBLE) AS s FROM part)
SELECT p_partkey, CASE WHEN a > 0 THEN b / a END AS size_ratio, CASE WHEN a > 0 THEN (b / a - 1) * 100 END AS size_change_percent, CASE WHEN s > 0 THEN b * 8.0::DOUBLE / s END AS bitrate_bps FROM p""",
    "report_compare": """WITH a AS (SELECT * FROM part WHERE p_partkey % 6 <> 0), b AS (SELECT * FROM part WHERE p_partkey % 10 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, (CAST(b.p_size * 103 AS DOUBLE) / (a.p_size * 100) - 1) * 100 AS size_percent, (CAST(b.p_size + 3 AS DOUBLE) / a.p_size - 1) * 100 AS encode_percent,
  (CAST(b.p_size AS DOUBLE) / a.p_size - 1) * 100 AS decode_percent, (CAST(b.p_size AS DOUBLE) / 2 + 3) - CAST(a.p_size AS DOUBLE) / 2 AS psnr_gain_db, CASE WHEN a.p_partkey IS NULL THEN 'before' WHEN b.p_partkey IS NULL THEN 'after' END AS missing
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""",
    "playback_checks": """SELECT event_id, (event_id % 2 + event_id % 3 % 2 + event_id % 5 % 2 + event_id % 7 % 2) = 0 AS passed, CASE WHEN event_id % 3 = 2 THEN 12.5::DOUBLE WHEN event_id % 2 = 0 AND event_id > 0 THEN CAST(event_id AS DOUBLE) ELSE 0.0::DOUBLE END AS duration_seconds FROM events""",
    "first_samples": f"WITH {TELEMETRY} SELECT stream, sample, drift_us FROM tm QUALIFY row_number() OVER (PARTITION BY stream ORDER BY sample) <= 20",
    "clock_marks": f"""WITH {INDEX}, t AS (SELECT stream, frame_no, CAST(floor(frame_no * 61.5::DOUBLE) AS BIGINT) AS s FROM ix)
SELECT stream, frame_no, CASE WHEN s < 3600 THEN printf('%02d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) END AS clock FROM t""",
}
