import pytest
from pyspark.sql import functions as F

from framelake.functions import exprs as E
from framelake.operators import blocks, ordered, reports


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rounding_and_wrapping(spark):
    got = one(spark, *[E.div_round(F.lit(v), F.lit(7)) for v in (-11, -10, -4, -3, 3, 4, 10, 11)], *[E.wrap8(F.lit(v)) for v in (-129, -128, 127, 128, 255)], E.idiv(F.lit(-7), F.lit(2)))
    assert got == (-2, -1, -1, 0, 0, 1, 1, 2, 127, -128, 127, -128, -1, -3)


def test_codes(spark):
    values = (-128, -1, 0, 1, 127)
    assert one(spark, *[E.zigzag(F.lit(v)) for v in values]) == (255, 1, 0, 2, 254)
    assert one(spark, *[E.unzigzag(E.zigzag(F.lit(v))) for v in values]) == values
    assert one(spark, *[E.bit_width(F.lit(v)) for v in (0, 1, 2, 127, 128, 255)]) == (0, 1, 2, 7, 8, 8)
    assert one(spark, *[E.varint_size(F.lit(v)) for v in (0, 127, 128, 16383, 16384, 1 << 28)]) == (1, 1, 2, 2, 3, 5)
    assert one(spark, E.level_bits(F.lit(0), F.lit(1)), E.level_bits(F.lit(7), F.lit(-100)), E.level_rate(F.lit(7), F.lit(8)), E.level_rate(F.lit(8), F.lit(1)), E.vector_rate(F.lit(0), F.lit(0))) == (4, 14 + 64, 1, 3, 1)


def test_rates_sizes_and_times(spark):
    texts = ["30000/1001", "25", "0/0", "x", None, "1/2/3", "29.97", "50/2", " 24000/1001 ", "-5", "0.5", "3.", "1000000/3000001", "999999999/1000000007", "1/300000", ".", "23.976023"]
    from fractions import Fraction

    def expected(t):
        try:
            f = Fraction(t)
            assert f > 0
            f = f.limit_denominator(100_000)
            return (f.numerator, f.denominator) if f else (30, 1)
        except (ValueError, TypeError, AssertionError, ZeroDivisionError):
            return 30, 1

    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*E.rate_parts("t")).collect()
    assert [tuple(r) for r in got] == [expected(t) for t in texts]
    assert one(spark, E.buffer_frames_rounded(F.lit(1920), F.lit(1080)), E.buffer_frames_rounded(F.lit(0), F.lit(0)), E.buffer_frames(F.lit(1920 * 1080 * 3 // 2))) == (22, 16, 21)
    assert one(spark, E.clock_text(F.lit(0)), E.clock_text(F.lit(3599.9)), E.clock_text(F.lit(3600)), E.clock_text(F.lit(36_061))) == ("00:00", "59:59", "1:00:00", "10:01:01")
    got = one(spark, E.blocks8(F.lit(1920), F.lit(1080)), E.macroblocks(F.lit(1920), F.lit(1080)), E.even_size(F.lit(1081)), E.audio_record_bytes(F.lit(1), F.lit(6), F.lit(32)), E.clock_text(F.lit(3725.9)))
    assert got == (48_720, 8_160, 1080, 28, "1:02:05")
    assert one(spark, E.pts_micros(F.lit(30), F.lit(30000), F.lit(1001)), E.frame_at(F.lit(1_001_000), F.lit(30000), F.lit(1001), F.lit(12))) == (1_001_000, 12)
    r, g, b = one(spark, *E.yuv_to_rgb(F.lit(235), F.lit(128), F.lit(128)))
    assert r == pytest.approx(1, abs=0.01) and g == pytest.approx(1, abs=0.01) and b == pytest.approx(1, abs=0.01)


def test_rates_of_many_digits(spark):
    texts = ["50.1234567", "29.970029970029970029970029970", "1234567890123.5", "9223372036854775807/2", "3" + "0" * 30 + "/1" + "0" * 30, "9223372036854775808", "1/300000", "31.1199999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    limited, exact = (rows.select(*E.rate_parts("t", **how)).collect() for how in ({}, {"largest": None}))
    assert [tuple(r) for r in limited] == [(5_009_639, 99_946), (30_000, 1001), (2_469_135_780_247, 2), ((1 << 63) - 1, 2), (3, 1), (30, 1), (30, 1), (778, 25)]
    # exactly, 27 places need a denominator that no long holds
    assert [tuple(r) for r in exact] == [(501_234_567, 10_000_000), (30, 1), (2_469_135_780_247, 2), ((1 << 63) - 1, 2), (3, 1), (30, 1), (1, 300_000), (311_199_999, 10_000_000)]


def test_scan_order_and_steps():
    assert blocks.SCAN[:8] == [0, 1, 8, 16, 9, 2, 3, 10] and sorted(blocks.SCAN) == list(range(64)) and blocks.SCAN[-3:] == [55, 62, 63]
    assert E.transform_steps(78)[0] == 40 and E.transform_steps(100, True)[0] == 10 and min(E.transform_steps(100)) >= 1


def test_arrays(spark):
    data = F.array(*map(F.lit, [5, 5, 0, 255, 7]))
    delta, back = one(spark, ordered.delta_mod256(data), ordered.restore_mod256(ordered.delta_mod256(data)))
    assert delta == [5, 0, 251, 255, 8] and back == [5, 5, 0, 255, 7]


def test_islands_are_cut(spark):
    df = spark.createDataFrame([(1, i, 0 if i < 600 else None) for i in range(605)], "k int, n int, v int")
    got = sorted((r["start"], r["v"], r["run"]) for r in ordered.islands(df, ["k"], "n", "v").collect())
    assert got == [(0, 0, 256), (256, 0, 256), (512, 0, 88), (600, None, 5)]


def test_log_lines_and_reports(spark, tmp_path):
    line = F.lit("RESULT frames=12 duration=0.5 size_mib=1.25 elapsed=2e-1 avg_fps=60.0 frames=13")
    assert one(spark, *reports.result_line(line)) == (13.0, 0.5, 1.25, 0.2, 60.0)
    assert one(spark, *reports.result_line(F.lit("frames=12"))) == (None,) * 5
    (tmp_path / "a.json").write_text('{"input": "a", "frames": 12,\n "decode_profile": {"wall_ms": 3.5}, "psnr_db": 45.5}')
    row = reports.read_reports(spark, str(tmp_path)).first()
    assert (row["frames"], row["decode_profile"], row["ssim"]) == (12, {"wall_ms": 3.5}, None)
