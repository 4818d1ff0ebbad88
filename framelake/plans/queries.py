"""The engine's operators over the star schema, by adapters; see sources/adapters.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as E
from framelake.operators import audio, blocks, catalog, costs, kernels, motion, ordered, quality, reports, telemetry
from framelake.plans import media_queries
from framelake.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUALITIES = (60, 78)
HOUR = 3_600_000_000


def _levels(spark: SparkSession, sf_dir: str, qualities=QUALITIES) -> DataFrame:
    """(stream, vec_id, samples, quality, step, levels)"""
    df = blocks.with_qualities(blocks.forward(A.vec_blocks(spark, sf_dir)), qualities)
    return df.withColumn("levels", blocks.quantized("coeffs", "step"))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_levels with tokens (runs and levels in scan order), restored and sse."""
    df = _levels(spark, sf_dir).withColumn("tokens", blocks.run_levels(blocks.scanned("levels")))
    df = blocks.inverse(df.withColumn("dequantized", blocks.dequantized("levels", "step")), "dequantized")
    return df.withColumn("sse", blocks.squared_error("samples", "restored"))


def wht_rate_by_label(spark, sf_dir):
    df = _coded(spark, sf_dir)
    last = F.element_at("tokens", -1)["pos"]
    df = df.select("stream", "quality", "sse", F.size("tokens").alias("n"), F.when(F.size("tokens") > 0, last).alias("last"), blocks.coded_bytes("tokens").alias("bytes"))
    return df.groupBy(F.col("stream").alias("label"), "quality").agg(
        F.count("*").alias("blocks"), F.avg((F.col("n") == 0).cast("double")).alias("zero_share"), F.avg("last").alias("mean_last"),
        F.sum("bytes").alias("coded_bytes"), F.sum("sse").alias("sse"),
    )


def wht_roundtrip_sse(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", "quality", "sse")


def wht_coefficients(spark, sf_dir):
    return blocks.forward(A.vec_blocks(spark, sf_dir)).select("vec_id", F.posexplode("coeffs").alias("place", "coeff"))


def zigzag_runs(spark, sf_dir):
    df = _levels(spark, sf_dir, (78,)).select("vec_id", F.explode(blocks.run_levels(blocks.scanned("levels"))).alias("t"))
    return df.select("vec_id", "t.pos", "t.run", "t.level")


def level_byte_cost(spark, sf_dir):
    t = _levels(spark, sf_dir).select("stream", "quality", F.explode(blocks.run_levels(blocks.scanned("levels"))).alias("t"))
    varint = E.varint_size(F.col("t.run")) + E.varint_size(E.zigzag(F.col("t.level")))
    return t.groupBy(F.col("stream").alias("label"), "quality").agg(
        F.count("*").alias("levels"), F.sum(E.level_rate(F.col("t.run"), F.col("t.level"))).cast("long").alias("token_bytes"), F.sum(varint).cast("long").alias("varint_bytes"))


def rice_k2_bit_cost(spark, sf_dir):
    df = _levels(spark, sf_dir).select("stream", "quality", blocks.coded_bits(blocks.run_levels(blocks.scanned("levels"))).alias("bits"))
    return df.groupBy(F.col("stream").alias("label"), "quality").agg(F.sum("bits").alias("bits"), F.count_if(F.col("bits") > 0).alias("coded_blocks"))


def _modes(spark, sf_dir, rice):
    df = costs.with_modes(kernels.code_statistics(A.byte_blocks(spark, sf_dir)), rice=rice)
    return df.groupBy("doc_id", "mode").agg(F.count("*").alias("blocks"), F.sum("mode_bytes").alias("mode_bytes"), F.sum("nonzero").alias("nonzero"), F.max("width").alias("width"))


def block_modes(spark, sf_dir):
    return _modes(spark, sf_dir, False)


def block_modes_rice(spark, sf_dir):
    return _modes(spark, sf_dir, True)


def _deltas(spark, sf_dir):
    return kernels.byte_deltas(A.byte_blocks(spark, sf_dir)).select("doc_id", "block", "delta")


def byte_delta(spark, sf_dir):
    return _deltas(spark, sf_dir).select("doc_id", "block", F.array_join(F.col("delta").cast("array<string>"), " ").alias("delta"))


def byte_delta_restore(spark, sf_dir):
    return kernels.byte_sums(_deltas(spark, sf_dir)).select("doc_id", "block", F.array_join(F.col("bytes").cast("array<string>"), " ").alias("bytes"))


def run_islands_256(spark, sf_dir):
    return ordered.islands(A.event_index(spark, sf_dir), ["stream"], "frame_no", "frame_type", 256)


def frame_census(spark, sf_dir):
    return catalog.census(A.event_index(spark, sf_dir), ["stream"])


def payload_totals(spark, sf_dir):
    return catalog.payload_totals(A.event_index(spark, sf_dir), ["stream"], raw_bytes=1920 * 1080 * 3 // 2)


def gop_summary(spark, sf_dir):
    df = ordered.groups_of_pictures(A.event_index(spark, sf_dir), ["stream"], "frame_no")
    return df.groupBy("stream", "gop").agg(F.count("*").alias("frames"), F.min("frame_no").alias("first_frame"), F.max("since_key").alias("max_since_key"))


def seek_plan(spark, sf_dir):
    return catalog.seek_plan(A.event_index(spark, sf_dir), ["stream"])


def next_keyframe(spark, sf_dir):
    frames = catalog.key_frame_after(A.event_index(spark, sf_dir), ["stream"])
    return frames.where("frame_type = 2").select("stream", "frame_no", "next_key")


def record_offsets(spark, sf_dir):
    return ordered.record_offsets(A.event_index(spark, sf_dir), ["stream"], "frame_no", "packed_size").select("stream", "frame_no", "record_offset")


def valid_prefix(spark, sf_dir):
    good = ordered.valid_prefix(A.event_index(spark, sf_dir), ["stream"], "frame_no", F.col("value") <= 100)
    return good.groupBy("stream").agg(F.count("*").alias("frames"), F.sum("packed_size").alias("bytes"))


def repair_index(spark, sf_dir):
    return catalog.repaired(A.event_index(spark, sf_dir), ["stream"], F.col("value") <= 100).select("stream", "frame_no", "frame_type", "record_offset")


def index_mismatch(spark, sf_dir):
    frames = A.event_index(spark, sf_dir)
    index = frames.where("event_id % 101 <> 0").withColumn("frame_type", F.when(F.col("event_id") % 97 == 0, 2 - F.col("frame_type")).otherwise(F.col("frame_type")))
    return catalog.index_mismatch(index, frames.where("event_id % 103 <> 0"), ["stream"])


def offset_order(spark, sf_dir):
    frames = ordered.record_offsets(A.event_index(spark, sf_dir), ["stream"], "frame_no", "packed_size")
    odd = frames.withColumn("record_offset", F.when(F.col("event_id") % 89 == 0, F.lit(0).cast("long")).otherwise(F.col("record_offset")))
    return ordered.not_rising(odd, ["stream"], "frame_no", "record_offset").select("stream", "frame_no")


def presentation_asof(spark, sf_dir):
    frames = A.event_index(spark, sf_dir)
    start = frames.groupBy("stream").agg(F.min("pts_us").alias("a"), F.max("pts_us").alias("b"))
    ticks = start.select("stream", F.explode(F.sequence("a", "b", F.lit(12 * HOUR))).alias("clock_us"))
    return catalog.dropped(catalog.presented(ticks, frames, ["stream"]), ["stream"])


def _pcm(spark, sf_dir, bits=8):
    return audio.with_scale(audio.blocks(A.event_pcm(spark, sf_dir), ["stream"]), bits)


def pcm_block_scale(spark, sf_dir):
    return _pcm(spark, sf_dir).select("stream", "block", "anchor", "max_delta", "scale")


def pcm_levels(spark, sf_dir):
    df = audio.with_codes(_pcm(spark, sf_dir), rounds=1)
    return df.select("stream", "block", F.posexplode(F.arrays_zip("levels", "codes")).alias("n", "t")).select("stream", "block", "n", F.col("t.levels").alias("level"), F.col("t.codes").alias("code"))


def pcm_snr(spark, sf_dir):
    df = audio.with_codes(_pcm(spark, sf_dir), rounds=1).withColumn("back", audio.decoded("codes", "anchor", "scale"))
    power = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    df = df.select("stream", power.alias("signal"), blocks.squared_error("samples", "back").alias("noise"))
    df = df.groupBy("stream").agg(F.sum("signal").alias("signal"), F.sum("noise").alias("noise"))
    return df.withColumn("snr_db", quality.snr(F.col("signal"), F.col("noise")))


def pack6_groups(spark, sf_dir):
    df = audio.with_codes(_pcm(spark, sf_dir, 6), 6, rounds=1)
    return df.select("stream", "block", F.posexplode(audio.packed6("codes")).alias("g", "packed"))


def _pictures(spark, sf_dir):
    return motion.with_previous(A.vec_frames(spark, sf_dir), ["stream"], "frame_no")


def temporal_residual(spark, sf_dir):
    df = _pictures(spark, sf_dir).where("previous is not null").withColumn("r", motion.residual())
    nonzero = F.size(F.filter("r", lambda x: x != 0))
    return df.select("stream", "frame_no", nonzero.alias("nonzero"), blocks.total(F.transform("r", lambda x: F.abs(x))).alias("abs_sum"))


def scene_repeat_decision(spark, sf_dir):
    df = _pictures(spark, sf_dir).withColumn("score", motion.sampled_difference(8, 8, 2))
    return df.select("stream", "frame_no", "score", motion.frame_decision(F.col("score"), F.col("frame_no"), 78, 120, 6.0).alias("frame_type"))


def block_motion_accept(spark, sf_dir):
    return motion.best_motion(_pictures(spark, sf_dir), ["stream", "frame_no"], 8, 8)


def candidate_topk(spark, sf_dir):
    return motion.shortlist(A.line_candidates(spark, sf_dir), "block", 2).select("block", "ord", "place")


def rd_argmin(spark, sf_dir):
    return motion.least_cost(A.line_candidates(spark, sf_dir), "block")


def median_predictor(spark, sf_dir):
    cells = F.arrays_zip(F.col("samples").alias("value"), ordered.grid_median("samples", 8, 8).alias("predicted"))
    df = A.vec_blocks(spark, sf_dir).select("vec_id", F.posexplode(cells).alias("i", "c"))
    bytes_ = E.varint_size(E.zigzag(F.col("c.value") - F.col("c.predicted")))
    return df.select("vec_id", (F.col("i") % 8).alias("x"), E.idiv("i", 8).cast("int").alias("y"), "c.predicted", bytes_.alias("bytes"))


def dc_predictor(spark, sf_dir):
    off = F.zip_with("samples", ordered.grid_median("samples", 8, 8, corner="left"), lambda a, b: a - b)
    df = A.vec_blocks(spark, sf_dir).select("vec_id", off.alias("off"))
    return df.select("vec_id", blocks.total(F.transform("off", lambda x: F.abs(x))).alias("abs_residual"), F.size(F.filter("off", lambda x: x == 0)).cast("long").alias("hits"))


def yuv_to_rgb(spark, sf_dir):
    at = lambda k: E.clamp(F.expr(f"element_at(samples, i + {k})") + 128, 0, 255)
    df = A.vec_blocks(spark, sf_dir).select("stream", "vec_id", "samples", F.explode(F.sequence(F.lit(1), F.lit(62))).alias("i"))
    r, g, b = E.yuv_to_rgb(at(0), at(1), at(2))
    return df.select("stream", r.alias("r"), g.alias("g"), b.alias("b")).groupBy(F.col("stream").alias("label")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def qstep_table(spark, sf_dir):
    q = spark.range(1, 101).select(F.col("id").cast("int").alias("quality"))
    cells = q.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("chroma", F.explode(F.array(F.lit(False), F.lit(True))))
    return cells.withColumn("step", E.transform_step("quality", "u", "v", F.col("chroma")))


def quality_table(spark, sf_dir):
    q = spark.range(1, 101).select(F.col("id").cast("int").alias("quality"))
    tables = {
        "luma_step": E.LUMA_STEPS, "chroma_step": E.CHROMA_STEPS, "dead_zone_plain": E.DEAD_ZONE_PLAIN, "dead_zone_fast": E.DEAD_ZONE_FAST,
        "residual_step": E.RESIDUAL_STEPS, "repeat_plain": E.REPEAT_PLAIN, "repeat_fast": E.REPEAT_FAST,
    }
    return q.withColumns({name: E.by_quality("quality", t) for name, t in tables.items()})


def preset_parts(spark, sf_dir):
    presets = spark.createDataFrame(E.PRESETS, "preset string, quality int, key_interval int, scene int, finalists int")
    part = A.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p[0]) for p in E.PRESETS]), (F.col("p_size") % 5 + 1).cast("int")).alias("preset"))
    # five rows
    return part.join(F.broadcast(presets), "preset").select("p_partkey", "preset", "quality", "key_interval", "finalists")


def motion_codes(spark, sf_dir):
    dx, dy = (F.col("l_linenumber") * 2 - 7), (F.col("l_quantity").cast("int") % 25 - 12)
    df = A.table(spark, sf_dir, "lineitem").select(dx.alias("dx"), dy.alias("dy")).groupBy("dx", "dy").agg(F.count("*").alias("n"))
    df = df.withColumn("packed", E.pack_motion("dx", "dy"))
    return df.select("dx", "dy", "n", "packed", E.unpack_motion_x("packed").alias("back_x"), E.unpack_motion_y("packed").alias("back_y"), E.halve_vector("dx").alias("chroma_dx"), E.vector_rate("dx", "dy").alias("rate"), E.popcount("packed").alias("ones"))


def time_marks(spark, sf_dir):
    pts = E.pts_micros("frame_no", F.lit(30000), F.lit(1001))
    df = A.event_index(spark, sf_dir).select("stream", "frame_no", pts.alias("pts"))
    return df.select("stream", "frame_no", "pts", E.frame_at("pts", F.lit(30000), F.lit(1001), F.lit(1 << 30)).alias("back"), E.clock_text(F.col("pts") / 1_000_000).alias("clock"))


def sample_quantizer(spark, sf_dir):
    df = A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("v"), (F.col("p_size") * 2).alias("quality"))
    luma = E.by_quality("quality", E.LUMA_STEPS)
    d = E.wrap8(F.col("v") - 17)
    return df.select("p_partkey", E.quantize_sample("v", luma).alias("sample"), E.quantize_residual(d, E.by_quality("quality", E.DEAD_ZONE_FAST), E.by_quality("quality", E.RESIDUAL_STEPS)).alias("residual"), E.bit_width("v").alias("width"), E.unzigzag(E.zigzag(d)).alias("back"), E.div_round(d, 7).alias("rounded"))


def picture_sizes(spark, sf_dir):
    df = A.table(spark, sf_dir, "part").select("p_partkey", E.even_size(F.col("p_size") * 40 + 16).alias("w"), E.even_size(F.col("p_partkey") % 1000 + 17).alias("h"))
    size = E.idiv(F.col("w") * F.col("h") * 3, 2)
    return df.select("p_partkey", "w", "h", E.blocks8("w", "h").alias("blocks"), E.macroblocks("w", "h").alias("macroblocks"), E.buffer_frames_rounded("w", "h").alias("buffered"), E.buffer_frames(size).alias("buffered_down"), E.audio_record_bytes(F.lit(2), F.lit(6), F.col("w")).alias("audio_bytes"), E.buffer_frames(size, 96 << 20, 4, 24).alias("player_buffered"))


def drift_stats(spark, sf_dir):
    return telemetry.drift_stats(A.telemetry(spark, sf_dir), ["stream"])


def late_drops(spark, sf_dir):
    return telemetry.late_drops(A.telemetry(spark, sf_dir), ["stream"])


def speed_windows(spark, sf_dir):
    return telemetry.speed_summary(telemetry.speeds(A.telemetry(spark, sf_dir), ["stream"], 8 * HOUR, 6 * HOUR), ["stream"])


def freeze_events(spark, sf_dir):
    return telemetry.freezes(A.telemetry(spark, sf_dir), ["stream"], 12 * HOUR)


def profile_kv(spark, sf_dir):
    line = F.format_string("RESULT frames=%d duration=%s size_mib=%s elapsed=1.5 avg_fps=%s", "event_id", F.col("value").cast("string"), F.lit("2.25"), F.lit("6e1"))
    return A.table(spark, sf_dir, "events").select("event_id", *reports.result_line(line))


def headroom(spark, sf_dir):
    df = A.table(spark, sf_dir, "events").select("event_id", (F.col("value") + 20).alias("fps"), F.lit(60.0).alias("realtime"))
    return reports.with_headroom(df, "fps", "realtime").select("event_id", "headroom", "headroom_class")


def psnr_pooled(spark, sf_dir):
    df = _coded(spark, sf_dir).select("quality", "sse", F.lit(64).alias("n"))
    return quality.pooled(df, ["quality"])


def crc_by_document(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        wht_rate_by_label, wht_roundtrip_sse, wht_coefficients, zigzag_runs, level_byte_cost, rice_k2_bit_cost, block_modes, block_modes_rice, byte_delta,
        byte_delta_restore, run_islands_256, frame_census, payload_totals, gop_summary, seek_plan, next_keyframe, record_offsets, valid_prefix, repair_index,
        index_mismatch, offset_order, presentation_asof, pcm_block_scale, pcm_levels, pcm_snr, pack6_groups, temporal_residual, scene_repeat_decision,
        block_motion_accept, candidate_topk, rd_argmin, median_predictor, dc_predictor, yuv_to_rgb, qstep_table, quality_table, preset_parts, motion_codes,
        time_marks, sample_quantizer, picture_sizes, drift_stats, late_drops, speed_windows, freeze_events, profile_kv, headroom, psnr_pooled, crc_by_document,
    )
} | media_queries.QUERIES
