"""Benchmark reports and log lines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import exprs as E

# Keys of a report.
REPORT = """input string, output string, preset string, codec int, actual_codec int, input_bytes long, output_bytes long,
 wall_seconds double, verified boolean, frames long, i_frames long, p_frames long, repeat_frames long, duration_seconds double,
 avg_fps double, decode_fps double, psnr_db double, ssim double, encode_peak_memory_bytes long, decode_peak_memory_bytes long, encoder_elapsed_seconds double, encode_profile map<string,double>, decode_profile map<string,double>"""


def key_texts(line: Column | str) -> Column:
    """The name=value words of a log line, as a map of texts; the last of equal names counts."""
    words = F.filter(F.split(E.col(line), r"\s+"), lambda w: F.instr(w, "=") > 1)
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def key_values(line: Column | str) -> Column:
    """The name=number words of a log line, as a map; what is no number is left out."""
    numbers = F.transform_values(key_texts(line), lambda _, v: v.try_cast("double"))
    return F.map_filter(numbers, lambda _, v: v.isNotNull())


def result_line(line: Column | str) -> list[Column]:
    """frames, duration, size_mib, elapsed and avg_fps of a RESULT line; nulls on others."""
    m = F.when(E.col(line).contains("RESULT"), key_values(line))
    return [F.try_element_at(m, F.lit(k)).alias(k) for k in ("frames", "duration", "size_mib", "elapsed", "avg_fps")]


def progress_line(line: Column | str) -> Column:
    """The fields of a PROGRESS line, as a map of texts; null on other lines."""
    return F.when(F.startswith(E.col(line), F.lit("PROGRESS ")), key_texts(F.substring(E.col(line), 10, 1 << 20)))


def player_status(line: Column | str) -> list[Column]:
    """audio_clock, drift, dropped, audio_queue_kb, video_queue_kb, kind and video_clock of a player's status line; nulls on others.

    Words are found by their names, and numbers may stand apart from them.
    """
    line = E.col(line)
    kind = F.when(line.contains("A-V:"), "A-V").when(line.contains("M-V:"), "M-V")
    before, after = F.substring_index(line, "-V:", 1), F.substring_index(line, "-V:", -1)
    word = lambda text, name: F.element_at(F.split(F.ltrim(F.substring_index(text, name, -1)), r"[^0-9.-]"), 1)
    clock = F.element_at(F.split(F.rtrim(F.regexp_replace(before, "[AM]$", "")), r"\s+"), -1)
    complete = kind.isNotNull() & after.contains("fd=") & after.contains("aq=") & after.contains("vq=")
    clock, drift = clock.try_cast("double"), word(after, "-V:").try_cast("double")
    values = {"audio_clock": clock, "drift": drift, "dropped": word(after, "fd=").try_cast("int"), "audio_queue_kb": word(after, "aq=").try_cast("int"), "video_queue_kb": word(after, "vq=").try_cast("int")}
    fine = F.coalesce(complete & F.least(*[v.isNotNull() for v in values.values()]), F.lit(False))
    out = [F.when(fine, v).alias(k) for k, v in values.items()]
    return [*out, F.when(fine, kind).alias("kind"), F.when(fine, F.round(clock - drift, 6)).alias("video_clock")]


def summed_profile(df: DataFrame, key: list[str], profile: str = "profile") -> DataFrame:
    """Counters (a map of name to number in each row, one row per thread) summed by key and name; partial sums travel."""
    return df.select(*key, F.explode(profile).alias("counter", "value")).groupBy(*key, "counter").agg(F.sum("value").alias("value"))


def with_ratios(reports: DataFrame) -> DataFrame:
    """Reports with size_ratio, size_change_percent and bitrate_bps; null where a divisor is zero."""
    ratio = F.try_divide(F.col("output_bytes").cast("double"), F.col("input_bytes").cast("double"))
    rate = F.try_divide(F.col("output_bytes") * 8.0, F.col("duration_seconds"))
    return reports.withColumns({"size_ratio": ratio, "size_change_percent": (ratio - 1) * 100, "bitrate_bps": rate})


def compared_reports(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Reports of two runs side by side: changes of size, rate and quality in percent or dB, and which side is missing."""
    columns = ["output_bytes", "avg_fps", "decode_fps", "psnr_db"]
    a = before.select(*key, F.lit(True).alias("__a"), *[F.col(c).alias(f"{c}_before") for c in columns])
    b = after.select(*key, F.lit(True).alias("__b"), *[F.col(c).alias(f"{c}_after") for c in columns])
    both = a.join(b, key, "full_outer")
    percent = lambda c: (F.try_divide(F.col(f"{c}_after").cast("double"), F.col(f"{c}_before").cast("double")) - 1) * 100
    missing = F.when(F.col("__a").isNull(), "before").when(F.col("__b").isNull(), "after")
    return both.select(*key, percent("output_bytes").alias("size_percent"), percent("avg_fps").alias("encode_percent"), percent("decode_fps").alias("decode_percent"), (F.col("psnr_db_after") - F.col("psnr_db_before")).alias("psnr_gain_db"), missing.alias("missing"))


def playback_passed(freezes: Column, slow: Column, fast: Column, pitch: Column) -> Column:
    """Whether a playback run had no event of any kind; missing counts as none."""
    return F.coalesce(freezes, F.lit(0)) + F.coalesce(slow, F.lit(0)) + F.coalesce(fast, F.lit(0)) + F.coalesce(pitch, F.lit(0)) == 0


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    reports.write.mode("errorifexists").json(path)


def duration_of(*candidates: Column) -> Column:
    """The first positive duration among texts or numbers; 0 if there is none."""
    seconds = [c.try_cast("double") for c in candidates]
    return F.coalesce(*[F.when(s > 0, s) for s in seconds], F.lit(0.0))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark reports (a JSON object per file), one row each, with an explicit schema."""
    return spark.read.schema(REPORT).json(path, multiLine=True)


def with_headroom(df: DataFrame, fps: str, realtime: str) -> DataFrame:
    """``df`` with headroom (decode rate over real time) and its class."""
    x = F.try_divide(F.col(fps).cast("double"), F.col(realtime).cast("double"))
    return df.withColumn("headroom", x).withColumn("headroom_class", E.headroom_class(x))
