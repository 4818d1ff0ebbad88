"""Playback telemetry as streams. Watermarks and windows are this engine's own; players have none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SAMPLE = "stream long, wall_us long, audio_us long, drift_us long, queue_depth int, dropped int"
EVENT = "stream long, kind string, from_us long, length_us long"


def read_samples(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Samples arriving as JSON lines; the number of files of a batch bounds what is in flight."""
    return spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_time(samples: DataFrame, delay: str = "1 minute") -> DataFrame:
    return samples.withColumn("at", F.timestamp_micros("wall_us")).withWatermark("at", delay)


def windowed(samples: DataFrame, length: str = "10 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Drift, drops and underruns by stream and tumbling (or sliding) window."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    out = with_time(samples, delay).groupBy("stream", window.alias("w")).agg(
        F.count("*").alias("samples"), F.max(F.abs("drift_us")).alias("max_abs_drift_us"), F.sum("dropped").alias("drops"), F.count_if(F.col("queue_depth") == 0).alias("underruns"))
    return out.select("stream", F.col("w.start").alias("start"), "samples", "max_abs_drift_us", "drops", "underruns")


def sessions(samples: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Stretches of playback without a pause longer than ``gap``."""
    out = with_time(samples, delay).groupBy("stream", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("samples"))
    return out.select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def on_time(samples: DataFrame, fps: int = 30, frames: float = 1.25) -> DataFrame:
    """Samples that are not later than so many frame times: a rule on each row, not a bound on event time."""
    return samples.where(F.col("drift_us") <= frames * 1_000_000 / fps)


def latched_events(samples: DataFrame, gap_us: int = 500_000, forget_ms: int | None = None) -> DataFrame:
    """One event per freeze (no sample for more than ``gap_us``) and per underrun (queue empty), until it ends.

    With ``forget_ms`` a stream that sends nothing for so long is forgotten, so state doesn't grow with streams that have ended: for
    queries that run on. One that ends with its input (run_once) needs none, and would wait for its timers for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, empty = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("wall_us")
        events = []
        for wall, depth in zip(rows["wall_us"].tolist(), rows["queue_depth"].tolist()):
            if last is not None and wall - last > gap_us:
                events.append((key[0], "freeze", last, wall - last))
            if depth == 0 and not empty:
                events.append((key[0], "underrun", wall, 0))
            empty, last = depth == 0, wall if last is None else max(last, wall)
        state.update((last, empty))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(events, columns=["stream", "kind", "from_us", "length_us"])

    return samples.groupBy("stream").applyInPandasWithState(step, EVENT, "last long, empty boolean", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into Parquet; the end of the input ends the run."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
