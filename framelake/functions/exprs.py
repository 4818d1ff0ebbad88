"""Exact-integer scalar functions as Spark columns.

All arguments are columns (or ints, where a parameter says so). Scalar expressions are compiled with the
query; array lambdas, where a function uses them, are interpreted by Spark; ``rate_parts`` reads texts as Arrow batches. Division truncates toward zero unless a name says otherwise, and nothing relies on
overflow, which raises under ANSI mode.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the quality scale, as (quality at least, value), then the value below all.
LUMA_STEPS = [(97, 1), (92, 1), (86, 2), (78, 2), (70, 3), (62, 4), (54, 5), (46, 6)], 8
CHROMA_STEPS = [(97, 1), (92, 2), (86, 3), (78, 4), (70, 5), (62, 7), (54, 8), (46, 10)], 12
DEAD_ZONE_PLAIN = [(76, 0), (68, 2), (56, 3)], 4
DEAD_ZONE_FAST = [(86, 0), (78, 1), (70, 2), (60, 3)], 4
RESIDUAL_STEPS = [(82, 1), (76, 2), (68, 3)], 4
REPEAT_PLAIN = [(90, 0.0), (82, 0.15), (76, 0.35), (68, 0.60)], 0.85
REPEAT_FAST = [(92, 0.0), (84, 0.12), (76, 0.32), (68, 0.58)], 0.85
TRANSFORM_BASE = [(96, 1), (88, 2), (82, 3), (79, 4), (75, 5), (70, 7), (62, 9)], 13
# Name, quality, key interval, scene threshold, finalists.
PRESETS = [
    ("veryfast", 68, 90, 32, 0), ("fast", 74, 105, 31, 1), ("compact", 72, 150, 29, 2), ("balanced", 78, 120, 30, 1), ("quality", 88, 150, 29, 3),
]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def idiv(a, b) -> Column:
    """Integer division toward zero, as a long."""
    return F.call_function("div", col(a).cast("long"), col(b).cast("long"))


def by_quality(q, table) -> Column:
    steps, last = table
    out = None
    for least, value in steps:
        out = F.when(col(q) >= least, value) if out is None else out.when(col(q) >= least, value)
    return out.otherwise(last)


def clamp(v, lo, hi) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(v)))


def wrap8(v) -> Column:
    """A difference of bytes as a signed byte, modulo 256."""
    return F.pmod(col(v) + 128, F.lit(256)) - 128


def div_round(v, d) -> Column:
    """Integer division rounded half away from zero; d > 0."""
    v, d = col(v).cast("long"), col(d).cast("long")
    return F.when(v < 0, -idiv(-v + idiv(d, 2), d)).otherwise(idiv(v + idiv(d, 2), d))


def zigzag(v) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    v = col(v).cast("long")
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(z) -> Column:
    z = col(z).cast("long")
    return F.when(z % 2 == 1, -idiv(z + 1, 2)).otherwise(idiv(z, 2))


def zigzag8(v) -> Column:
    """zigzag of a signed byte, at most 255 (-128 and 127's neighbour share no code below it)."""
    return F.least(zigzag(v), F.lit(255).cast("long"))


def bit_width(v) -> Column:
    """Bits that a value of 0 to 255 needs; 0 for 0."""
    v = col(v)
    out = F.lit(0)
    for i in range(8):
        out = out + (v >= 1 << i).cast("int")
    return out


def varint_size(v) -> Column:
    v = col(v)
    return 1 + sum(((v >= F.lit(1 << 7 * i)).cast("int") for i in range(1, 5)), F.lit(0))


def pack_motion(dx, dy) -> Column:
    """Two signed bytes as 16 bits, dx low."""
    return col(dx).bitwiseAND(F.lit(255)) + F.shiftleft(col(dy).bitwiseAND(F.lit(255)), 8)


def _signed(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def unpack_motion_x(m) -> Column:
    return _signed(col(m).bitwiseAND(F.lit(255)))


def unpack_motion_y(m) -> Column:
    return _signed(F.shiftright(col(m), 8).bitwiseAND(F.lit(255)))


def quantize_sample(v, step) -> Column:
    """A sample of 0 to 255 to the nearest multiple of the step, at most 255."""
    return F.least(idiv(col(v) + idiv(step, 2), step) * col(step), F.lit(255).cast("long"))


def quantize_residual(d, dead_zone, step) -> Column:
    """0 within the dead zone, else the nearest multiple of the step, at most 127 in size."""
    d, step = col(d).cast("long"), col(step)
    size = F.least(idiv(F.abs(d) + idiv(step, 2), step) * step, F.lit(127).cast("long"))
    return F.when(F.abs(d) <= col(dead_zone), F.lit(0).cast("long")).when(step <= 1, d).when(d < 0, -size).otherwise(size)


def transform_step(q, u, v, chroma=False) -> Column:
    """Quantizer step of the transform coefficient (u, v)."""
    base, freq = by_quality(q, TRANSFORM_BASE), col(u) + col(v)
    step = idiv(base * 8 * (16 + 2 * freq + F.when(freq >= 8, 4).otherwise(0)) + 8, 16)
    step = F.when(col(chroma), idiv(step * 5 + 2, 4)).otherwise(step)
    return F.greatest(F.lit(1).cast("long"), step)


def transform_steps(quality: int, chroma: bool = False) -> list[int]:
    """The 64 steps of one quality, by coefficient place v * 8 + u."""
    base = next((b for least, b in TRANSFORM_BASE[0] if quality >= least), TRANSFORM_BASE[1])
    out = []
    for v in range(8):
        for u in range(8):
            step = (base * 8 * (16 + 2 * (u + v) + 4 * (u + v >= 8)) + 8) // 16
            out.append(max(1, (step * 5 + 2) // 4 if chroma else step))
    return out


def median3(a, b, c) -> Column:
    a, b, c = col(a), col(b), col(c)
    return a + b + c - F.least(a, b, c) - F.greatest(a, b, c)


def vector_rate(dx, dy) -> Column:
    """Bytes of a vector difference: 1 if zero, else a token and two varints."""
    coded = 1 + varint_size(zigzag(dx)) + varint_size(zigzag(dy))
    return F.when((col(dx) == 0) & (col(dy) == 0), 1).otherwise(coded)


def level_rate(run, level) -> Column:
    """Bytes of a run and level: one token if both are small, else an escape and two varints."""
    z = zigzag(level)
    return F.when((col(run) < 8) & (z >= 1) & (z <= 16), 1).otherwise(1 + varint_size(run) + varint_size(z))


def level_bits(run, level) -> Column:
    """Bits of a unary run (escape from 7 on) and a Rice level of k = 2 (escape from quotient 31 on)."""
    z = zigzag(level)
    return F.when(col(run) < 7, col(run) + 1).otherwise(14) + F.when(idiv(z, 4) < 31, idiv(z, 4) + 3).otherwise(64)


def pts_micros(n, fps_num, fps_den) -> Column:
    return idiv(col(n).cast("long") * col(fps_den) * 1_000_000, fps_num)


def frame_at(micros, fps_num, fps_den, last) -> Column:
    return F.least(idiv(col(micros).cast("long") * col(fps_num), col(fps_den) * 1_000_000), col(last).cast("long"))


def halve_vector(v) -> Column:
    """A luma vector's chroma half, toward zero."""
    return idiv(v, 2)


def yuv_to_rgb(y, u, v) -> list[Column]:
    """BT.601 limited-range samples (0 to 255) as red, green and blue in 0 to 1."""
    # The standard's factors.
    y = 1.164383 * (col(y) / 255.0 - 0.0627451)
    u, v = col(u) / 255.0 - 0.5, col(v) / 255.0 - 0.5
    whole = (y + 1.596027 * v, y - 0.391762 * u - 0.812968 * v, y + 2.017232 * u)
    return [clamp(x, F.lit(0.0), F.lit(1.0)) for x in whole]


def buffer_frames(frame_bytes, budget=64 << 20, least=8, most=32) -> Column:
    """Pictures that fit in a budget, rounded down; for a picture of no size as for one of one byte."""
    return clamp(idiv(F.lit(budget), F.greatest(col(frame_bytes), F.lit(1))), F.lit(least), F.lit(most))


def buffer_frames_rounded(w, h) -> Column:
    """Pictures of about 64 MiB, rounded half to even, from 8 to 32; 16 for a picture of no size."""
    mib = col(w) * col(h) * 1.5 / (1 << 20)
    return F.when(mib <= 0, 16).otherwise(clamp(F.bround(F.lit(64.0) / mib).cast("int"), F.lit(8), F.lit(32)))


LARGEST_DENOMINATOR = 100_000
RATE = re.compile(r"\+?(?:([0-9]+)/([0-9]+)|([0-9]*)(?:\.([0-9]*))?)")


def rate_parts(text, largest: int | None = LARGEST_DENOMINATOR) -> list[Column]:
    """Numerator and denominator of a rate, "num/den", "num" or a decimal, reduced, with a denominator of ``largest`` at most (None: as it
    stands); 30 and 1 where it is no positive rate. Terms may have any number of digits that Python's int takes; a result
    that no long holds counts as no rate. Texts are read as Arrow batches: Euclid's steps as array lambdas would be interpreted, once for each use."""

    def terms(text: str | None) -> tuple[int, int]:
        none, found = (30, 1), RATE.fullmatch(text.strip()) if text else None
        if not found:
            return none
        num, den, whole, places = found.groups()
        try:
            num, den = (int(whole + (places or "")), 10 ** len(places or "")) if num is None else (int(num), int(den))
        except ValueError:
            return none
        if not (num and den):
            return none
        common = math.gcd(num, den)
        num, den = num // common, den // common
        if largest and den > largest:
            num, den = Fraction(num, den).limit_denominator(largest).as_integer_ratio()
        return (num, den) if num and max(num, den) < 1 << 63 else none

    def parts(texts: pa.Array) -> pa.Array:
        found = [terms(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], names=["num", "den"])

    found = F.arrow_udf(parts, "num long, den long")(col(text))
    return [found["num"], found["den"]]


def even_size(v) -> Column:
    return col(v) - col(v) % 2


def audio_record_bytes(channels, bits, frames) -> Column:
    """Bytes of one audio block: anchors and scales, then codes of 8 or 6 bits."""
    codes = col(channels) * col(frames)
    return 4 * col(channels) + F.when(col(bits) == 8, codes).otherwise(idiv(codes * 6 + 7, 8))


def blocks8(w, h) -> Column:
    """8x8 blocks of a 4:2:0 picture."""
    cw, ch = idiv(w, 2), idiv(h, 2)
    return idiv(col(w) + 7, 8) * idiv(col(h) + 7, 8) + 2 * idiv(cw + 7, 8) * idiv(ch + 7, 8)


def macroblocks(w, h) -> Column:
    return idiv(col(w) + 15, 16) * idiv(col(h) + 15, 16)


def clock_text(seconds) -> Column:
    """Minutes and seconds, and hours before them from one hour on."""
    s = F.floor(col(seconds)).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", idiv(s, 3600), idiv(s, 60) % 60, s % 60)).otherwise(F.format_string("%02d:%02d", idiv(s, 60), s % 60))


def popcount(v) -> Column:
    return F.bit_count(col(v))


def headroom_class(x) -> Column:
    """How far decoding outruns real time."""
    return F.when(col(x) >= 1.8, "good").when(col(x) >= 1.15, "borderline").otherwise("too slow")
