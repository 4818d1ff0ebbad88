"""Playback telemetry: drift, drops, speed, freezes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift_stats(samples: DataFrame, key: list[str]) -> DataFrame:
    drift = F.abs("drift_us")
    return samples.groupBy(*key).agg(
        F.count("*").alias("samples"), F.sum(drift).alias("sum_abs_drift_us"), F.max(drift).alias("max_abs_drift_us"),
        F.sum("dropped").alias("drops"), F.count_if(F.col("queue_depth") == 0).alias("underruns"),
    ).withColumn("avg_abs_drift_us", F.col("sum_abs_drift_us") / F.col("samples"))


def late_drops(samples: DataFrame, key: list[str], fps: int = 30, frames: float = 1.25) -> DataFrame:
    """Samples that came more than ``frames`` frame times late."""
    limit = frames * 1_000_000 / fps
    late = F.col("drift_us") > limit
    return samples.groupBy(*key).agg(F.count_if(late).alias("late"), F.max(F.when(late, F.col("drift_us"))).alias("max_late_us"), F.sum(F.when(late, F.col("drift_us"))).alias("sum_late_us"))


def speeds(samples: DataFrame, key: list[str], window_us: int, least_us: int) -> DataFrame:
    """``samples`` with speed: audio time over wall time since the last sample at least ``window_us``
    older, or the first one; null over less than ``least_us``. A range frame of the ordered stream."""
    w = Window.partitionBy(*key).orderBy("wall_us")
    clocks = F.struct("wall_us", "audio_us")
    old = F.max(clocks).over(w.rangeBetween(Window.unboundedPreceding, -window_us))
    first = F.min(clocks).over(w.rangeBetween(Window.unboundedPreceding, 0))
    df = samples.withColumn("__old", F.coalesce(old, first))
    wall = F.col("wall_us") - F.col("__old.wall_us")
    return df.withColumn("speed", F.when(wall >= least_us, (F.col("audio_us") - F.col("__old.audio_us")) / wall)).drop("__old")


def speed_summary(with_speed: DataFrame, key: list[str]) -> DataFrame:
    s = F.col("speed")
    return with_speed.groupBy(*key).agg(F.count("speed").alias("windows"), F.count_if(s < 0.80).alias("slow"), F.count_if(s > 1.20).alias("fast"), F.avg("speed").alias("mean_speed"))


def freezes(samples: DataFrame, key: list[str], gap_us: int) -> DataFrame:
    """One row per pause of more than ``gap_us`` between two samples: where it starts and how long it is."""
    before = F.lag("wall_us").over(Window.partitionBy(*key).orderBy("wall_us", "sample"))
    gaps = samples.select(*key, before.alias("from_us"), (F.col("wall_us") - before).alias("gap_us"))
    return gaps.where(F.col("gap_us") > gap_us)
