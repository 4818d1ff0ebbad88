"""Frame catalogs: census, sizes, seeking, verification and repair as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import layout
from framelake.operators.ordered import record_offsets, valid_prefix


def census(frames: DataFrame, key: list[str]) -> DataFrame:
    """Frames of each type, and bytes, of each stream."""
    kinds = [F.count_if(F.col("frame_type") == i).alias(n) for i, n in ((0, "key_frames"), (1, "p_frames"), (2, "repeats"))]
    return frames.groupBy(*key).agg(F.count("*").alias("frames"), *kinds)


def payload_totals(frames: DataFrame, key: list[str], raw_bytes: int, fps: int = 30) -> DataFrame:
    """Bytes, mean bits per second, share of the raw size of each stream."""
    n, size = F.count("*"), F.sum("packed_size")
    out = frames.groupBy(*key).agg(n.alias("frames"), size.alias("payload_bytes"))
    return out.withColumns({
        "bit_rate": F.try_divide(F.col("payload_bytes") * 8.0 * fps, F.col("frames")),
        "raw_share": F.try_divide(F.col("payload_bytes").cast("double"), F.col("frames").cast("double") * raw_bytes),
    })


def key_frame_before(frames: DataFrame, key: list[str]) -> DataFrame:
    """``frames`` with seek_frame: the last key frame at or before each; a range join by one ordered pass."""
    w = Window.partitionBy(*key).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("seek_frame", F.last(F.when(F.col("frame_type") == 0, F.col("frame_no")), ignorenulls=True).over(w))


def key_frame_after(frames: DataFrame, key: list[str]) -> DataFrame:
    """``frames`` with next_key: the first key frame after each; null if there is none."""
    w = Window.partitionBy(*key).orderBy("frame_no").rowsBetween(1, Window.unboundedFollowing)
    return frames.withColumn("next_key", F.first(F.when(F.col("frame_type") == 0, F.col("frame_no")), ignorenulls=True).over(w))


def sample_positions(counts: DataFrame, shares: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """One row per stream and share: the frame at that share of its length, rounded half to even."""
    share = F.explode(F.array(*map(F.lit, shares)))
    return counts.withColumn("share", share).withColumn("frame_no", F.bround((F.col("frames") - 1) * F.col("share")).cast("int"))


def seek_plan(frames: DataFrame, key: list[str]) -> DataFrame:
    """For each of five targets of a stream: the key frame to start at and the frames to decode."""
    counts = frames.groupBy(*key).agg(F.count("*").alias("frames"))
    targets = sample_positions(counts).select(*key, "share", "frame_no")
    found = targets.join(key_frame_before(frames, key).select(*key, "frame_no", "seek_frame"), [*key, "frame_no"])
    return found.withColumn("decode_frames", F.col("frame_no") - F.col("seek_frame") + 1)


def index_mismatch(index: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """Entries of an index and records that don't agree: missing on a side, or of different types."""
    a = index.select(*key, "frame_no", F.col("frame_type").alias("index_type"))
    b = frames.select(*key, "frame_no", F.col("frame_type").alias("record_type"))
    both = a.join(b, [*key, "frame_no"], "full_outer")
    fault = F.when(F.col("index_type").isNull(), "not in index").when(F.col("record_type").isNull(), "no record").when(F.col("index_type") != F.col("record_type"), "type differs")
    return both.withColumn("fault", fault).where("fault is not null")


def repaired(frames: DataFrame, key: list[str], valid) -> DataFrame:
    """The index of the longest valid prefix, with new offsets."""
    return record_offsets(valid_prefix(frames, key, "frame_no", valid), key, "frame_no", "packed_size")


def presented(ticks: DataFrame, frames: DataFrame, key: list[str], slack_us: int = 2000) -> DataFrame:
    """For each clock tick, the newest frame that is due (pts_us at most the tick and the slack).

    Ticks and frames are one ordered stream, in which the last frame seen is carried along:
    one sort of both, instead of a join on a range.
    """
    both = ticks.select(*key, F.col("clock_us").alias("at"), F.lit(1).alias("is_tick"), F.lit(None).cast("int").alias("frame_no"), "clock_us")
    both = both.unionByName(frames.select(*key, (F.col("pts_us") - slack_us).alias("at"), F.lit(0).alias("is_tick"), "frame_no", F.lit(None).cast("long").alias("clock_us")))
    w = Window.partitionBy(*key).orderBy("at", "is_tick", "frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shown", F.max("frame_no").over(w)).where("is_tick = 1").select(*key, "clock_us", "shown")


def dropped(shown: DataFrame, key: list[str]) -> DataFrame:
    """``shown`` with skipped: frames that became due since the tick before and were not shown."""
    w = Window.partitionBy(*key).orderBy("clock_us")
    step = F.coalesce(F.col("shown"), F.lit(-1)) - F.coalesce(F.lag("shown").over(w), F.lit(-1))
    return shown.withColumn("skipped", F.greatest(step - 1, F.lit(0)))




def frame_range(frames: DataFrame, start: int, count: int | None = None) -> DataFrame:
    """The frames from ``start`` on, ``count`` of them at most; a filter on the number, which sources push down."""
    kept = frames.where(F.col("frame_no") >= start)
    return kept if count is None else kept.where(F.col("frame_no") < start + count)


def with_faults(records: DataFrame) -> DataFrame:
    """Frame records (mark_ok, frame_type, codec, number, frame_no, packed_size, and end: bytes past the file's end) with fault: the first rule that each breaks."""
    rule = layout.record_fault(*[F.col(c) for c in ("mark_ok", "frame_type", "codec", "number", "frame_no", "packed_size", "end")], F.lit(0))
    return records.withColumn("fault", rule)
