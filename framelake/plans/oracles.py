"""DuckDB SQL with the rows of each query, written from the definitions and over single samples."""

from __future__ import annotations


def _case(x: str, steps, last) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} THEN {v}" for a, v in steps) + f" ELSE {last} END"


def _vsize(v: str) -> str:
    return f"(CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END)"


def _zig(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN -2 * ({v}) - 1 ELSE 2 * ({v}) END)"


def _div_round(v: str, d: str) -> str:
    return f"(sign({v}) * ((abs({v}) + ({d}) // 2) // ({d})))"


def _median(a: str, b: str, c: str) -> str:
    return f"({a} + {b} + {c} - least({a}, {b}, {c}) - greatest({a}, {b}, {c}))"


_base = _case("quality", [(96, 1), (88, 2), (82, 3), (79, 4), (75, 5), (70, 7), (62, 9)], 13)
_step = f"greatest(1, (({_base}) * 8 * (16 + 2 * (u + v) + CASE WHEN u + v >= 8 THEN 4 ELSE 0 END) + 8) // 16)"

SAMPLES = """
s AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 32) AS INTEGER) AS x FROM embeddings)"""

TRANSFORM = (
    SAMPLES
    + f""",
seq AS (SELECT unnest([0, 4, 6, 2, 3, 7, 5, 1]) AS nat, generate_subscripts([0, 4, 6, 2, 3, 7, 5, 1], 1) - 1 AS u),
h AS (SELECT u, k, CASE WHEN bit_count(CAST(nat & k AS INTEGER)) % 2 = 0 THEN 1 ELSE -1 END AS s FROM seq, (SELECT CAST(range AS INTEGER) AS k FROM range(8))),
sg AS (SELECT a.u AS u, b.u AS v, a.k AS sx, b.k AS sy, a.s * b.s AS s, row_number() OVER (PARTITION BY a.k, b.k ORDER BY a.u + b.u, CASE WHEN (a.u + b.u) % 2 = 0 THEN a.u ELSE b.u END) - 1 AS pos FROM h a, h b),
c AS (SELECT label, vec_id, u, v, any_value(pos) AS pos, CAST(sum(x * sg.s) AS BIGINT) AS c FROM s JOIN sg ON i = sy * 8 + sx GROUP BY label, vec_id, u, v),
st AS (SELECT c.*, quality, {_step} AS step FROM c, (SELECT unnest([60, 78]) AS quality)),
q AS (SELECT *, CAST({_div_round("c", "step")} AS BIGINT) AS q FROM st),
nz AS (SELECT *, pos - lag(pos, 1, -1) OVER (PARTITION BY vec_id, quality ORDER BY pos) - 1 AS run FROM q WHERE q <> 0),
back AS (SELECT vec_id, quality, sy * 8 + sx AS i, CAST(sum(q * step * sg.s) AS BIGINT) AS y FROM q JOIN sg USING (u, v) GROUP BY ALL),
sse AS (SELECT s.label, b.vec_id, quality, CAST(sum((x - {_div_round("y", "64")}) * (x - {_div_round("y", "64")})) AS BIGINT) AS sse FROM back b JOIN s USING (vec_id, i) GROUP BY ALL)"""
)

BYTES = """
hx AS (SELECT doc_id, hex(CAST(encode(text) AS BLOB)) AS h FROM documents WHERE length(text) > 0),
pt AS (SELECT doc_id, b AS block, rpad(substr(h, CAST(b * 128 + 1 AS BIGINT), 128), 128, '0') AS p FROM (SELECT doc_id, h, CAST(unnest(range((length(h) + 127) // 128)) AS INTEGER) AS b FROM hx)),
byt AS (SELECT doc_id, block, i, CAST(CAST('0x' || substr(p, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS INTEGER) AS v FROM pt, (SELECT CAST(range AS INTEGER) AS i FROM range(64)))"""

_wrap = "((({v} + 128) % 256 + 256) % 256 - 128)"


def _modes(rice: bool) -> str:
    ways = "[{'b': 8 * width, 'o': 0, 'm': width}, {'b': 8 + nz, 'o': 1, 'm': 9}" + (
        ", {'b': r0, 'o': 2, 'm': 10 + k0}, {'b': r1, 'o': 3, 'm': 10 + k1}, {'b': r2, 'o': 4, 'm': 10 + k2}" if rice else ""
    ) + "]"
    return f"""
WITH {BYTES},
z AS (SELECT doc_id, block, least({_zig(_wrap.format(v="(v - coalesce(lag(v) OVER (PARTITION BY doc_id, block ORDER BY i), 0))"))}, 255) AS z FROM byt),
g AS (SELECT doc_id, block, max(z) AS m, CAST(count(*) FILTER (z <> 0) AS BIGINT) AS nz, CAST(sum(z) AS BIGINT) AS sz, list(z) AS zs FROM z GROUP BY ALL),
w AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE CAST(floor(log2(m)) AS BIGINT) + 1 END AS width, least((sz + 32) // 64, 255) AS mean FROM g),
k AS (SELECT *, greatest(0, least(5, (CASE WHEN mean = 0 THEN 0 ELSE CAST(floor(log2(mean)) AS BIGINT) + 1 END) - 2)) AS k1 FROM w),
kk AS (SELECT *, greatest(0, k1 - 1) AS k0, least(5, k1 + 1) AS k2 FROM k),
r AS (SELECT *, (CAST(list_sum(list_transform(zs, lambda x: x >> CAST(k0 AS INTEGER))) AS BIGINT) + 64 * (1 + k0) + 7) // 8 AS r0,
  (CAST(list_sum(list_transform(zs, lambda x: x >> CAST(k1 AS INTEGER))) AS BIGINT) + 64 * (1 + k1) + 7) // 8 AS r1,
  (CAST(list_sum(list_transform(zs, lambda x: x >> CAST(k2 AS INTEGER))) AS BIGINT) + 64 * (1 + k2) + 7) // 8 AS r2 FROM kk),
b AS (SELECT *, list_min({ways}) AS best FROM r)
SELECT doc_id, CAST(CASE WHEN width = 0 THEN 0 ELSE best.m END AS INTEGER) AS mode, count(*) AS blocks,
  CAST(sum(CASE WHEN width = 0 THEN 0 ELSE best.b END) AS BIGINT) AS mode_bytes, CAST(sum(nz) AS BIGINT) AS nonzero, CAST(max(width) AS INTEGER) AS width
FROM b GROUP BY 1, 2"""


INDEX = """
ix AS (SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame_no, event_id,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS frame_type, CAST(round(value * 64) AS BIGINT) AS packed_size, epoch_us(ts) AS pts_us, value FROM events)"""

OFFSETS = """
of AS (SELECT *, CAST(coalesce(sum(packed_size + 32) OVER (PARTITION BY stream ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 96 AS BIGINT) AS record_offset FROM ix)"""

GOOD = """
ok AS (SELECT *, min(CASE WHEN value <= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS ok FROM ix)"""

PCM = """
p AS (SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS n, greatest(-32768, least(32767, CAST(round(value * 64) AS INTEGER))) AS x FROM events),
pb AS (SELECT stream, n // 32 AS block, n % 32 AS n, x, abs(x - coalesce(lag(x) OVER (PARTITION BY stream, n // 32 ORDER BY n), x)) AS d, first_value(x) OVER (PARTITION BY stream, n // 32 ORDER BY n) AS anchor FROM p)"""


def _pcm(limit: int, bias: int) -> str:
    return f"""{PCM},
sc AS (SELECT stream, block, CAST(any_value(anchor) AS INTEGER) AS anchor, max(d) AS max_delta, CAST(greatest(1, (max(d) + {limit - 1}) // {limit}) AS BIGINT) AS scale FROM pb GROUP BY ALL),
lv AS (SELECT stream, block, n, x, scale, sc.anchor, CAST({_div_round("(x - sc.anchor)", "scale")} AS BIGINT) AS level FROM pb JOIN sc USING (stream, block)),
cd AS (SELECT *, CAST(greatest(-{limit}, least({limit}, level - coalesce(lag(level) OVER (PARTITION BY stream, block ORDER BY n), 0))) + {bias} AS INTEGER) AS code FROM lv)"""


FRAMES = (
    SAMPLES
    + """,
fn AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_no FROM embeddings),
f AS (SELECT label AS stream, frame_no, i, x FROM s JOIN fn USING (vec_id)),
pr AS (SELECT a.stream, a.frame_no, a.i, a.x, b.x AS p FROM f a LEFT JOIN f b ON a.stream = b.stream AND a.frame_no = b.frame_no + 1 AND a.i = b.i)"""
)

CANDIDATES = """
cand AS (SELECT l_orderkey AS block, l_linenumber AS ord, CAST(round(l_extendedprice) AS BIGINT) AS distortion, CAST(l_quantity AS BIGINT) AS rate FROM lineitem)"""

GRID = (
    SAMPLES
    + """,
gr AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, x AS value FROM s),
nb AS (SELECT g.*, coalesce(l.value, 0) AS l, coalesce(t.value, 0) AS t, coalesce(r.value, t.value, 0) AS r, coalesce(c.value, 0) AS c
  FROM gr g LEFT JOIN gr l ON l.vec_id = g.vec_id AND l.x = g.x - 1 AND l.y = g.y LEFT JOIN gr t ON t.vec_id = g.vec_id AND t.x = g.x AND t.y = g.y - 1
  LEFT JOIN gr r ON r.vec_id = g.vec_id AND r.x = g.x + 1 AND r.y = g.y - 1 LEFT JOIN gr c ON c.vec_id = g.vec_id AND c.x = g.x - 1 AND c.y = g.y - 1)"""
)

TELEMETRY = """
tm AS (SELECT user_id AS stream, event_id AS sample, epoch_us(ts) AS wall_us, CAST(round(value * 64) AS BIGINT) * 4 AS drift_us, epoch_us(ts) + CAST(round(value * 64) AS BIGINT) * 4000000 AS audio_us,
  event_id % 8 AS queue_depth, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS dropped FROM events)"""

_score = "(sum(abs(a.x - b.x)) * 256) // 16"
_luma = _case("quality", [(97, 1), (92, 1), (86, 2), (78, 2), (70, 3), (62, 4), (54, 5), (46, 6)], 8)
_fast = _case("quality", [(86, 0), (78, 1), (70, 2), (60, 3)], 4)
_res = _case("quality", [(82, 1), (76, 2), (68, 3)], 4)

ORACLES: dict[str, str] = {
    "wht_rate_by_label": f"""WITH {TRANSFORM},
b AS (SELECT vec_id, quality, max(pos) AS last, CAST(1 + sum({_vsize("run")} + {_vsize(_zig("q"))}) AS BIGINT) AS bytes FROM nz GROUP BY ALL)
SELECT e.label, e.quality, count(*) AS blocks, avg(CASE WHEN b.last IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_share, avg(b.last) AS mean_last,
  CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS coded_bytes, CAST(sum(e.sse) AS BIGINT) AS sse
FROM sse e LEFT JOIN b USING (vec_id, quality) GROUP BY 1, 2""",
    "wht_roundtrip_sse": f"WITH {TRANSFORM} SELECT vec_id, quality, sse FROM sse",
    "wht_coefficients": f"WITH {TRANSFORM} SELECT vec_id, v * 8 + u AS place, c AS coeff FROM c",
    "zigzag_runs": f"WITH {TRANSFORM} SELECT vec_id, pos, run, q AS level FROM nz WHERE quality = 78",
    "level_byte_cost": f"""WITH {TRANSFORM} SELECT label, quality, count(*) AS levels,
  CAST(sum(CASE WHEN run < 8 AND {_zig("q")} <= 16 THEN 1 ELSE 1 + {_vsize("run")} + {_vsize(_zig("q"))} END) AS BIGINT) AS token_bytes,
  CAST(sum({_vsize("run")} + {_vsize(_zig("q"))}) AS BIGINT) AS varint_bytes FROM nz GROUP BY 1, 2""",
    "rice_k2_bit_cost": f"""WITH {TRANSFORM},
b AS (SELECT label, quality, vec_id, 6 + sum(CASE WHEN run < 7 THEN run + 1 ELSE 14 END + CASE WHEN {_zig("q")} // 4 < 31 THEN {_zig("q")} // 4 + 3 ELSE 64 END) AS bits FROM nz GROUP BY ALL),
a AS (SELECT DISTINCT label, quality FROM q)
SELECT a.label, a.quality, CAST(coalesce(sum(bits), 0) AS BIGINT) AS bits, count(bits) AS coded_blocks FROM a LEFT JOIN b USING (label, quality) GROUP BY 1, 2""",
    "block_modes": _modes(False),
    "block_modes_rice": _modes(True),
    "byte_delta": f"""WITH {BYTES}, d AS (SELECT doc_id, block, i, (v - coalesce(lag(v) OVER (PARTITION BY doc_id, block ORDER BY i), 0) + 256) % 256 AS d FROM byt)
SELECT doc_id, block, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY i) AS delta FROM d GROUP BY 1, 2""",
    "byte_delta_restore": f"WITH {BYTES} SELECT doc_id, block, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS bytes FROM byt GROUP BY 1, 2",
    "run_islands_256": f"""WITH {INDEX},
i AS (SELECT stream, frame_no, frame_type, frame_no - row_number() OVER (PARTITION BY stream, frame_type ORDER BY frame_no) AS g FROM ix),
n AS (SELECT *, (row_number() OVER (PARTITION BY stream, frame_type, g ORDER BY frame_no) - 1) // 256 AS piece FROM i)
SELECT stream, min(frame_no) AS start, frame_type, count(*) AS run FROM n GROUP BY stream, frame_type, g, piece""",
    "frame_census": f"WITH {INDEX} SELECT stream, count(*) AS frames, count(*) FILTER (frame_type = 0) AS key_frames, count(*) FILTER (frame_type = 1) AS p_frames, count(*) FILTER (frame_type = 2) AS repeats FROM ix GROUP BY 1",
    "payload_totals": f"""WITH {INDEX} SELECT stream, count(*) AS frames, CAST(sum(packed_size) AS BIGINT) AS payload_bytes, CAST(sum(packed_size) AS DOUBLE) * 8 * 30 / count(*) AS bit_rate,
  CAST(sum(packed_size) AS DOUBLE) / (count(*) * 3110400.0::DOUBLE) AS raw_share FROM ix GROUP BY 1""",
    "gop_summary": f"""WITH {INDEX}, g AS (SELECT stream, frame_no, count(*) FILTER (frame_type = 0) OVER w AS gop, frame_no - max(CASE WHEN frame_type = 0 THEN frame_no END) OVER w AS since FROM ix WINDOW w AS (PARTITION BY stream ORDER BY frame_no ROWS UNBOUNDED PRECEDING))
SELECT stream, gop, count(*) AS frames, min(frame_no) AS first_frame, max(since) AS max_since_key FROM g GROUP BY 1, 2""",
    "seek_plan": f"""WITH {INDEX}, n AS (SELECT stream, count(*) AS frames FROM ix GROUP BY 1),
t AS (SELECT stream, share, CAST(round_even((frames - 1) * share, 0) AS INTEGER) AS frame_no FROM n, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS share)),
k AS (SELECT stream, frame_no AS seek_frame FROM ix WHERE frame_type = 0)
SELECT t.stream, t.share, t.frame_no, k.seek_frame, t.frame_no - k.seek_frame + 1 AS decode_frames FROM t ASOF LEFT JOIN k ON t.stream = k.stream AND t.frame_no >= k.seek_frame""",
    "next_keyframe": f"""WITH {INDEX}, k AS (SELECT stream, frame_no AS next_key FROM ix WHERE frame_type = 0)
SELECT i.stream, i.frame_no, k.next_key FROM (SELECT * FROM ix WHERE frame_type = 2) i ASOF LEFT JOIN k ON i.stream = k.stream AND i.frame_no < k.next_key""",
    "record_offsets": f"WITH {INDEX}, {OFFSETS} SELECT stream, frame_no, record_offset FROM of",
    "valid_prefix": f"WITH {INDEX}, {GOOD} SELECT stream, count(*) AS frames, CAST(sum(packed_size) AS BIGINT) AS bytes FROM ok WHERE ok = 1 GROUP BY 1",
    "repair_index": f"""WITH {INDEX}, {GOOD}, g AS (SELECT * FROM ok WHERE ok = 1)
SELECT stream, frame_no, frame_type, CAST(coalesce(sum(packed_size + 32) OVER (PARTITION BY stream ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 96 AS BIGINT) AS record_offset FROM g""",
    "index_mismatch": f"""WITH {INDEX},
a AS (SELECT stream, frame_no, CASE WHEN event_id % 97 = 0 THEN 2 - frame_type ELSE frame_type END AS index_type FROM ix WHERE event_id % 101 <> 0),
b AS (SELECT stream, frame_no, frame_type AS record_type FROM ix WHERE event_id % 103 <> 0),
m AS (SELECT stream, frame_no, index_type, record_type, CASE WHEN index_type IS NULL THEN 'not in index' WHEN record_type IS NULL THEN 'no record' WHEN index_type <> record_type THEN 'type differs' END AS fault FROM a FULL JOIN b USING (stream, frame_no))
SELECT * FROM m WHERE fault IS NOT NULL""",
    "offset_order": f"""WITH {INDEX}, {OFFSETS}, o AS (SELECT stream, frame_no, CASE WHEN event_id % 89 = 0 THEN 0 ELSE record_offset END AS x FROM of),
l AS (SELECT *, lag(x) OVER (PARTITION BY stream ORDER BY frame_no) AS b FROM o) SELECT stream, frame_no FROM l WHERE x <= b""",
    "presentation_asof": f"""WITH {INDEX}, t AS (SELECT stream, unnest(range(min(pts_us), max(pts_us) + 1, 43200000000)) AS clock_us FROM ix GROUP BY 1),
f AS (SELECT stream, pts_us, max(frame_no) AS frame_no FROM ix GROUP BY 1, 2),
a AS (SELECT t.stream, t.clock_us, f.frame_no AS shown FROM t ASOF LEFT JOIN f ON t.stream = f.stream AND t.clock_us + 2000 >= f.pts_us)
SELECT *, greatest(coalesce(shown, -1) - coalesce(lag(shown) OVER (PARTITION BY stream ORDER BY clock_us), -1) - 1, 0) AS skipped FROM a""",
    "pcm_block_scale": f"WITH {_pcm(127, 128)} SELECT stream, block, anchor, max_delta, scale FROM sc",
    "pcm_levels": f"WITH {_pcm(127, 128)} SELECT stream, block, n, level, code FROM cd",
    "pcm_snr": f"""WITH {_pcm(127, 128)},
r AS (SELECT stream, x, greatest(-32768, least(32767, anchor + scale * sum(code - 128) OVER (PARTITION BY stream, block ORDER BY n))) AS y FROM cd),
a AS (SELECT stream, CAST(sum(CAST(x AS BIGINT) * x) AS BIGINT) AS signal, CAST(sum((x - y) * (x - y)) AS BIGINT) AS noise FROM r GROUP BY 1)
SELECT *, CASE WHEN noise = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(CAST(signal AS DOUBLE) / CAST(noise AS DOUBLE)) END AS snr_db FROM a""",
    "pack6_groups": f"WITH {_pcm(31, 32)} SELECT stream, block, n // 4 AS g, CAST(sum(code * power(64, n % 4)) AS INTEGER) AS packed FROM cd GROUP BY 1, 2, 3",
    "temporal_residual": f"""WITH {FRAMES}, d AS (SELECT stream, frame_no, {_wrap.format(v="(x - p)")} AS d FROM pr WHERE p IS NOT NULL),
r AS (SELECT *, CASE WHEN abs(d) <= 1 THEN 0 ELSE least((abs(d) + 1) // 2 * 2, 127) END AS r FROM d)
SELECT stream, frame_no, count(*) FILTER (r <> 0) AS nonzero, CAST(sum(r) AS BIGINT) AS abs_sum FROM r GROUP BY 1, 2""",
    "scene_repeat_decision": f"""WITH {FRAMES}, c AS (SELECT stream, frame_no, sum(abs(x - p)) / 16.0::DOUBLE AS score FROM pr WHERE i % 2 = 0 AND (i // 8) % 2 = 0 GROUP BY 1, 2)
SELECT stream, frame_no, CAST(score AS DOUBLE) AS score, CASE WHEN score IS NULL OR frame_no % 120 = 0 THEN 0 WHEN score <= 0.32 THEN 2 WHEN score < 6 THEN 1 ELSE 0 END AS frame_type FROM c""",
    "block_motion_accept": f"""WITH {FRAMES},
o AS (SELECT dx, dy, row_number() OVER (ORDER BY dy, dx) AS ord FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
sc AS (SELECT a.stream, a.frame_no, dx, dy, ord, CAST({_score} AS BIGINT) AS sad FROM f a CROSS JOIN o JOIN f b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1
  AND b.i = greatest(0, least(7, a.i // 8 - dy)) * 8 + greatest(0, least(7, a.i % 8 - dx)) WHERE a.i % 2 = 0 AND (a.i // 8) % 2 = 0 GROUP BY ALL),
z AS (SELECT stream, frame_no, sad AS zero_score FROM sc WHERE dx = 0 AND dy = 0),
b AS (SELECT stream, frame_no, min({{'score': sad + 24 * (abs(dx) + abs(dy)), 'ord': ord, 'dx': dx, 'dy': dy}}) AS b FROM sc WHERE dx <> 0 OR dy <> 0 GROUP BY 1, 2)
SELECT stream, frame_no, zero_score, b.dx AS dx, b.dy AS dy, b.score AS score, zero_score > 256 AND b.score + 384 < zero_score AND b.score * 100 < zero_score * 72 AS accepted FROM b JOIN z USING (stream, frame_no)""",
    "candidate_topk": f"""WITH {CANDIDATES}, m AS (SELECT *, ord = min(ord) OVER (PARTITION BY block) AS z FROM cand),
r AS (SELECT block, ord, row_number() OVER (PARTITION BY block ORDER BY z DESC, distortion, ord) AS place FROM m) SELECT * FROM r WHERE place <= 3""",
    "rd_argmin": f"""WITH {CANDIDATES}, r AS (SELECT *, distortion + rate AS cost, row_number() OVER (PARTITION BY block ORDER BY distortion + rate, ord, distortion) AS k FROM cand)
SELECT block, ord, cost, distortion, rate FROM r WHERE k = 1""",
    "median_predictor": f"WITH {GRID}, m AS (SELECT *, {_median('l', 't', 'r')} AS predicted FROM nb) SELECT vec_id, x, y, predicted, {_vsize(_zig('(value - predicted)'))} AS bytes FROM m",
    "dc_predictor": f"WITH {GRID}, m AS (SELECT *, {_median('l', 't', 'c')} AS p FROM nb) SELECT vec_id, CAST(sum(abs(value - p)) AS BIGINT) AS abs_residual, count(*) FILTER (value = p) AS hits FROM m GROUP BY 1",
    "yuv_to_rgb": f"""WITH {SAMPLES}, c AS (SELECT label, vec_id, i, greatest(0, least(255, x + 128)) / 255.0::DOUBLE AS c FROM s),
t AS (SELECT a.label, 1.164383::DOUBLE * (a.c - 0.0627451::DOUBLE) AS y, b.c - 0.5::DOUBLE AS u, d.c - 0.5::DOUBLE AS v FROM c a JOIN c b ON b.vec_id = a.vec_id AND b.i = a.i + 1 JOIN c d ON d.vec_id = a.vec_id AND d.i = a.i + 2)
SELECT label, avg(greatest(0, least(1, y + 1.596027::DOUBLE * v))) AS r, avg(greatest(0, least(1, y - 0.391762::DOUBLE * u - 0.812968::DOUBLE * v))) AS g, avg(greatest(0, least(1, y + 2.017232::DOUBLE * u))) AS b FROM t GROUP BY 1""",
    "qstep_table": f"""WITH g AS (SELECT CAST(a.range AS INTEGER) AS quality, CAST(b.range AS INTEGER) AS u, CAST(c.range AS INTEGER) AS v, chroma FROM range(1, 101) a, range(8) b, range(8) c, (SELECT unnest([false, true]) AS chroma))
SELECT quality, u, v, chroma, CAST(CASE WHEN chroma THEN greatest(1, ({_step} * 5 + 2) // 4) ELSE {_step} END AS BIGINT) AS step FROM g""",
    "quality_table": f"""SELECT CAST(range AS INTEGER) AS quality, {_luma.replace("quality", "range")} AS luma_step,
  {_case("range", [(97, 1), (92, 2), (86, 3), (78, 4), (70, 5), (62, 7), (54, 8), (46, 10)], 12)} AS chroma_step, {_case("range", [(76, 0), (68, 2), (56, 3)], 4)} AS dead_zone_plain,
  {_fast.replace("quality", "range")} AS dead_zone_fast, {_res.replace("quality", "range")} AS residual_step,
  CAST({_case("range", [(90, 0), (82, 0.15), (76, 0.35), (68, 0.60)], 0.85)} AS DOUBLE) AS repeat_plain, CAST({_case("range", [(92, 0), (84, 0.12), (76, 0.32), (68, 0.58)], 0.85)} AS DOUBLE) AS repeat_fast FROM range(1, 101)""",
    "preset_parts": """WITH p(i, preset, quality, key_interval, finalists) AS (VALUES (0, 'veryfast', 68, 90, 0), (1, 'fast', 74, 105, 1), (2, 'compact', 72, 150, 2), (3, 'balanced', 78, 120, 1), (4, 'quality', 88, 150, 3))
SELECT p_partkey, preset, quality, key_interval, finalists FROM part JOIN p ON p_size % 5 = i""",
    "motion_codes": f"""WITH m AS (SELECT l_linenumber * 2 - 7 AS dx, CAST(l_quantity AS INTEGER) % 25 - 12 AS dy, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, CAST((dx + 256) % 256 + ((dy + 256) % 256) * 256 AS INTEGER) AS packed FROM m)
SELECT dx, dy, n, packed, dx AS back_x, dy AS back_y, CAST(trunc(dx / 2) AS BIGINT) AS chroma_dx, CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 1 + {_vsize(_zig("dx"))} + {_vsize(_zig("dy"))} END AS rate, CAST(bit_count(packed) AS INTEGER) AS ones FROM c""",
    "time_marks": f"""WITH {INDEX}, t AS (SELECT stream, frame_no, CAST(frame_no AS BIGINT) * 1001000000 // 30000 AS pts FROM ix)
SELECT stream, frame_no, pts, pts * 30000 // 1001000000 AS back, CASE WHEN pts < 3600000000 THEN printf('%02d:%02d', pts // 60000000, pts // 1000000 % 60) ELSE printf('%d:%02d:%02d', pts // 3600000000, pts // 60000000 % 60, pts // 1000000 % 60) END AS clock FROM t""",
    "sample_quantizer": f"""WITH a AS (SELECT p_partkey, p_partkey % 256 AS v, p_size * 2 AS quality FROM part),
b AS (SELECT *, {_luma} AS st, {_fast} AS dz, {_res} AS rs, {_wrap.format(v="(v - 17)")} AS d FROM a)
SELECT p_partkey, CAST(least((v + st // 2) // st * st, 255) AS BIGINT) AS sample, CAST(CASE WHEN abs(d) <= dz THEN 0 WHEN rs <= 1 THEN d ELSE sign(d) * least((abs(d) + rs // 2) // rs * rs, 127) END AS BIGINT) AS residual,
  CAST(CASE WHEN v = 0 THEN 0 ELSE floor(log2(v)) + 1 END AS INTEGER) AS width, d AS back, CAST(sign(d) * ((abs(d) + 3) // 7) AS BIGINT) AS rounded FROM b""",
    "picture_sizes": """WITH a AS (SELECT p_partkey, (p_size * 40 + 16) // 2 * 2 AS w, (p_partkey % 1000 + 17) // 2 * 2 AS h FROM part)
SELECT p_partkey, w, h, (w + 7) // 8 * ((h + 7) // 8) + 2 * ((w // 2 + 7) // 8 * ((h // 2 + 7) // 8)) AS blocks, (w + 15) // 16 * ((h + 15) // 16) AS macroblocks,
  CAST(greatest(8, least(32, round_even(64.0::DOUBLE / (w * h * 1.5::DOUBLE / 1048576.0::DOUBLE), 0))) AS INTEGER) AS buffered, greatest(8, least(32, 67108864 // (w * h * 3 // 2))) AS buffered_down, 8 + (2 * w * 6 + 7) // 8 AS audio_bytes, greatest(4, least(24, 100663296 // (w * h * 3 // 2))) AS player_buffered FROM a""",
    "drift_stats": f"""WITH {TELEMETRY} SELECT stream, count(*) AS samples, CAST(sum(abs(drift_us)) AS BIGINT) AS sum_abs_drift_us, max(abs(drift_us)) AS max_abs_drift_us, CAST(sum(dropped) AS BIGINT) AS drops,
  count(*) FILTER (queue_depth = 0) AS underruns, CAST(sum(abs(drift_us)) AS DOUBLE) / count(*) AS avg_abs_drift_us FROM tm GROUP BY 1""",
    "late_drops": f"""WITH {TELEMETRY} SELECT stream, count(*) FILTER (drift_us * 30 > 1250000) AS late, max(drift_us) FILTER (drift_us * 30 > 1250000) AS max_late_us, CAST(sum(drift_us) FILTER (drift_us * 30 > 1250000) AS BIGINT) AS sum_late_us FROM tm GROUP BY 1""",
    "speed_windows": f"""WITH {TELEMETRY}, o AS (SELECT stream, wall_us, audio_us,
  coalesce(max({{'w': wall_us, 'a': audio_us}}) OVER (PARTITION BY stream ORDER BY wall_us RANGE BETWEEN UNBOUNDED PRECEDING AND 28800000000 PRECEDING), min({{'w': wall_us, 'a': audio_us}}) OVER (PARTITION BY stream)) AS o FROM tm),
s AS (SELECT stream, CASE WHEN wall_us - o.w >= 21600000000 THEN CAST(audio_us - o.a AS DOUBLE) / (wall_us - o.w) END AS speed FROM o)
SELECT stream, count(speed) AS windows, count(*) FILTER (speed < 0.8) AS slow, count(*) FILTER (speed > 1.2) AS fast, avg(speed) AS mean_speed FROM s GROUP BY 1""",
    "freeze_events": f"""WITH {TELEMETRY}, g AS (SELECT stream, lag(wall_us) OVER (PARTITION BY stream ORDER BY wall_us, sample) AS from_us, wall_us FROM tm)
SELECT stream, from_us, wall_us - from_us AS gap_us FROM g WHERE wall_us - from_us > 43200000000""",
    "profile_kv": "SELECT event_id, CAST(event_id AS DOUBLE) AS frames, value AS duration, 2.25::DOUBLE AS size_mib, 1.5::DOUBLE AS elapsed, 60.0::DOUBLE AS avg_fps FROM events",
    "headroom": "SELECT event_id, (value + 20) / 60.0::DOUBLE AS headroom, CASE WHEN (value + 20) / 60.0::DOUBLE >= 1.8 THEN 'good' WHEN (value + 20) / 60.0::DOUBLE >= 1.15 THEN 'borderline' ELSE 'too slow' END AS headroom_class FROM events",
    "psnr_pooled": f"""WITH {TRANSFORM}, a AS (SELECT quality, CAST(sum(sse) AS BIGINT) AS sse, count(*) * 64 AS samples FROM sse GROUP BY 1)
SELECT quality, sse, samples, CAST(sse AS DOUBLE) / samples AS mse, CASE WHEN sse = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / (CAST(sse AS DOUBLE) / samples)) END AS psnr_db FROM a""",
    "crc_by_document": """WITH RECURSIVE k(n, i, c) AS (SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT n, i + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM k WHERE i < 8),
t AS (SELECT list(c ORDER BY n) AS t FROM k WHERE i = 8),
d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))) AS b FROM d)
SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) AS crc32 FROM b, t""",
}
