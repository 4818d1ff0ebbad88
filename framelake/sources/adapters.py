"""Tables of the star schema as engine tables: blocks, samples, records, bytes, candidates.

A query over these shows an operator at work; they hold no media.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros():
    """Micros since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def vec_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, vec_id, samples): each embedding as an 8x8 block of integers in raster order."""
    sample = lambda v: F.round(v.cast("double") * 32).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("stream"), "vec_id", F.transform("embedding", sample).alias("samples"))


def vec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_blocks with frame_no: the place of a block in its stream, from 0."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy("vec_id")) - 1
    return vec_blocks(spark, sf_dir).withColumn("frame_no", place)


def event_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, n, sample): each user's event values as 16-bit samples."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    sample = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(F.col("value") * 64).cast("int")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), place.alias("n"), sample.alias("sample"))


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, frame_no, event_id, frame_type, packed_size, pts_us, value): each user's events as frame records."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 2).otherwise(1)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), place.alias("frame_no"), "event_id", kind.alias("frame_type"),
        F.round(F.col("value") * 64).cast("long").alias("packed_size"), epoch_micros().alias("pts_us"), "value",
    )


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, bytes): the UTF-8 bytes of each text in blocks of 64, the last one padded with zeros.

    Blocks are cut from the binary, in constant time each, and read as one Latin-1 character per byte.
    """
    data = F.col("text").cast("binary")
    n = F.ceil(F.octet_length("text") / 64).cast("int")
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", data.alias("data"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    part = F.expr("decode(rpad(substring(data, block * 64 + 1, 64), 64, X'00'), 'ISO-8859-1')")
    return docs.select("doc_id", "block", F.transform(F.split(part, ""), lambda c: F.ascii(c)).alias("bytes"))


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, ord, distortion, rate): each order's lines as candidates of one block."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("ord"),
        F.round("l_extendedprice").cast("long").alias("distortion"), F.col("l_quantity").cast("long").alias("rate"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, sample, wall_us, audio_us, drift_us, queue_depth, dropped): each user's events as player samples."""
    drift = F.round(F.col("value") * 64).cast("long") * 4
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("sample"), epoch_micros().alias("wall_us"), (epoch_micros() + drift * 1_000_000).alias("audio_us"),
        drift.alias("drift_us"), (F.col("event_id") % 8).cast("int").alias("queue_depth"), (F.col("event_type") == "error").cast("int").alias("dropped"),
    )


def byte_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, data, before): the UTF-8 bytes of each text in binaries of 64, the last one padded with zeros, and the byte before
    each block (0 before the first)."""
    data = F.col("text").cast("binary")
    n = F.ceil(F.octet_length("text") / 64).cast("int")
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", data.alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    before = F.when(F.col("block") > 0, F.conv(F.hex(F.expr("substring(whole, block * 64, 1)")), 16, 10).cast("int")).otherwise(0)
    return docs.select("doc_id", "block", F.expr("rpad(substring(whole, block * 64 + 1, 64), 64, X'00')").alias("data"), before.alias("before"))


def vec_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, vec_id, frame_no, samples, previous): embeddings as 8x8 luma blocks of bytes, with the one before in the stream."""
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x + 128))
    df = vec_frames(spark, sf_dir).withColumn("samples", F.transform("samples", byte))
    return df.withColumn("previous", F.lag("samples").over(Window.partitionBy("stream").orderBy("frame_no")))


def sheets(spark: SparkSession, sf_dir: str, stride: int = 8) -> DataFrame:
    """(sheet, picture): 64 embeddings in a row as 8x8 tiles of a 64x64 luma picture, a new one every ``stride`` embeddings; ids tell their order."""
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v.cast("double") * 32).cast("int") + 128))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("vec_id") - 63) / stride))
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", byte).alias("samples"), F.explode(F.sequence(first, F.floor(F.col("vec_id") / stride))).alias("sheet"))
    tiles = tiles.select("sheet", (F.col("vec_id") - F.col("sheet") * stride).cast("int").alias("tile"), "samples").where("tile between 0 and 63")
    # 64 tiles of 64 samples at most
    rows = tiles.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("tile", "samples"))).alias("t")).where("size(t) = 64")
    place = lambda i: F.element_at(F.element_at("t", (F.floor(i / 512) * 8 + F.floor(i % 64 / 8) + 1).cast("int"))["samples"], (F.floor(i % 512 / 64) * 8 + i % 8 + 1).cast("int"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.lpad(F.hex(place(i).cast("long")), 2, "0"))
    return rows.select("sheet", F.unhex(F.array_join(digits, "")).alias("picture"))


def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_index as frame records of a file, some of them broken: with mark_ok, codec, number and end."""
    df = event_index(spark, sf_dir)
    hurt = lambda n, bad, good: F.when(F.col("event_id") % n == 0, bad).otherwise(good)
    return df.select(
        "stream", "frame_no", "event_id", hurt(211, F.lit(3), F.col("frame_type")).alias("frame_type"), hurt(223, F.lit(2), 3 + F.col("event_id") % 7).alias("codec"),
        hurt(227, F.col("frame_no") + 1, F.col("frame_no")).alias("number"), (F.col("event_id") % 229 != 0).alias("mark_ok"),
        hurt(233, F.lit((512 << 20) + 1).cast("long"), F.col("packed_size")).alias("packed_size"), hurt(239, F.lit(2).cast("long"), F.lit(0).cast("long")).alias("end"),
    )
