"""Whole files: what they are, whether they hold together, repairing them, adding sound, reading raw pictures."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.codecs.bits import Malformed
from framelake.functions import layout
from framelake.operators import catalog
from framelake.sources import container as C


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: the header's fields, its size, and the frames of each type in its index."""
    headers = C.read(spark, path, "header", "permissive")
    counted = catalog.census(C.read(spark, path, "index", "permissive").where("error is null"), ["path"])
    out = headers.join(counted, "path", "left")
    rate = F.try_divide(F.col("fps_num").cast("double"), F.col("fps_den").cast("double"))
    return out.withColumn("fps", rate).withColumn("duration_seconds", F.col("duration_us") / 1_000_000)


def structure_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_no, fault): where header, index and records of a file disagree."""
    headers = C.read(spark, path, "header", "permissive")
    index = C.read(spark, path, "index", "permissive")
    records = C.read(spark, path, "scan", "permissive").where("error is null")
    broken = headers.unionByName(index, allowMissingColumns=True).where("error is not null").select("path", F.lit(None).cast("long").alias("frame_no"), F.col("error").alias("fault"))
    good = index.where("error is null")
    differ = catalog.index_mismatch(good, records, ["path"]).select("path", "frame_no", "fault")
    moved = good.alias("i").join(records.alias("r"), ["path", "frame_no"]).where("i.offset <> r.offset").select("path", "frame_no", F.lit("offset differs").alias("fault"))
    counted = good.groupBy("path").agg(F.count("*").alias("n"))
    count = headers.where("error is null").join(counted, "path", "left").where("frame_count <> coalesce(n, 0)").select("path", F.lit(None).cast("long").alias("frame_no"), F.lit("frame count differs").alias("fault"))
    return broken.distinct().union(differ).union(moved).union(count)


def audio_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per sound file: its header's fields, duration and size, or an error. Headers are cut from the files in expressions."""
    fields = [("major", 4, 1), ("minor", 5, 1), ("sample_rate", 12, 4), ("channels", 16, 2), ("code_bits", 18, 2), ("block_frames", 20, 4), ("quality", 24, 4), ("frames", 28, 8), ("blocks", 36, 8)]
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size"), F.substring("content", 1, 64).alias("data"))
    values = {name: layout.number(F.col("data"), at, n).cast("long") for name, at, n in fields}
    no_mark = (F.octet_length("data") < 64) | (F.substring("data", 1, 4) != F.lit(C.AUDIO_FILE_MARK)) | (F.substring("data", 9, 4) != F.lit(C.AUDIO_CODEC))
    fault = F.when(no_mark, "no audio file").otherwise(layout.audio_fault(values["channels"], values["code_bits"], values["block_frames"], values["sample_rate"]))
    seconds = F.try_divide(values["frames"].cast("double"), values["sample_rate"].cast("double"))
    return files.select("path", "file_size", *[v.alias(k) for k, v in values.items()], seconds.alias("duration_seconds"), fault.alias("error"))


def _rewrite(source: str, target: str, header: dict, sections: list) -> None:
    """A new file of a header and sections, each bytes or a (start, length) of the source; never in place."""
    part = f"{target}.new-{uuid.uuid4().hex}"
    with open(source, "rb") as f, open(part, "wb") as out:
        out.write(C.pack_header(header))
        for section in sections:
            if isinstance(section, bytes):
                out.write(section)
                continue
            f.seek(section[0])
            left = section[1]
            while left and (data := f.read(min(left, 1 << 22))):
                out.write(data)
                left -= len(data)
            if left:
                raise Malformed("section past the end")
    shutil.move(part, target)


def _index(entries: list[tuple[int, int]]) -> bytes:
    return C.INDEX_HEAD.pack(C.INDEX_MARK, len(entries)) + b"".join(C.INDEX_ENTRY.pack(*e) for e in entries)


def repair(source: str, target: str) -> int:
    """Writes a file of the records before the first broken one, with a new index; the number of its frames."""
    import os

    with open(source, "rb") as f:
        header = C.parse_header(f.read(C.HEADER.size))
        rows = list(C.scan_records(f, header, os.path.getsize(source)))
    if not rows:
        raise Malformed("no frame record to keep")
    start, end = rows[0][8], rows[-1][8] + C.RECORD.size + rows[-1][6]
    shift = C.HEADER.size - start
    entries = [(r[8] + shift, r[2]) for r in rows]
    header |= {
        "frame_count": len(rows), "frames_offset": C.HEADER.size, "index_offset": C.HEADER.size + end - start, "flags": header["flags"] & ~1,
        "audio_offset": 0, "audio_samples": 0, "duration_us": len(rows) * header["fps_den"] * 1_000_000 // header["fps_num"],
    }
    _rewrite(source, target, header, [(start, end - start), _index(entries)])
    return len(rows)


def add_audio(source: str, target: str, audio: bytes) -> None:
    """Writes a file with an audio file (as container.pack_audio_file makes it) as its sound."""
    import os

    sound = C.parse_audio_header(audio)
    with open(source, "rb") as f:
        header = C.parse_header(f.read(C.HEADER.size))
        C.read_index(f, header)
    size = os.path.getsize(source)
    header |= {
        "flags": header["flags"] | 1, "audio_offset": size, "audio_rate": sound["rate"], "audio_channels": sound["channels"], "audio_codec": 4, "audio_samples": sound["frames"],
        "duration_us": max(header["duration_us"], sound["frames"] * 1_000_000 // sound["rate"]),
    }
    record = C.AUDIO_RECORD.pack(C.AUDIO_MARK, 4, len(audio), sound["frames"]) + audio
    _rewrite(source, target, header, [(C.HEADER.size, size - C.HEADER.size), record])


def read_raw(spark: SparkSession, path: str, width: int, height: int, part_pictures: int = 64) -> DataFrame:
    """(path, frame_no, picture) of headerless planar 4:2:0 pictures; a cut last one is an error. Files are listed with their sizes, and
    tasks read their share of the pictures, each at its place."""
    size = width * height * 3 // 2
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    whole = F.when(F.col("length") % size != 0, F.raise_error(F.lit("a cut picture at the end"))).otherwise(F.col("length"))
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0, length div {size} - 1)"), F.lit(part_pictures).cast("long"))).alias("first"), (whole / size).cast("long").alias("n")).where("n > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(r["path"].replace("file:///", "file:/").replace("file:/", "file:///"))
                with store.open_input_file(at) as f:
                    f.seek(r["first"] * size)
                    for n in range(r["first"], min(r["first"] + part_pictures, r["n"])):
                        yield pa.RecordBatch.from_pydict({"path": [r["path"]], "frame_no": [n], "picture": pa.array([f.read(size)], pa.binary())})

    spread = parts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "first")
    return spread.mapInArrow(read, "path string, frame_no long, picture binary")


def planes(decoded: DataFrame, width: int, height: int) -> DataFrame:
    """(path, frame_no, plane, width, height, samples): a picture's three planes, cut from its bytes."""
    w, h, luma = width, height, width * height
    cuts = [(0, w, h, 1, luma), (1, w // 2, h // 2, luma + 1, luma // 4), (2, w // 2, h // 2, luma + luma // 4 + 1, luma // 4)]
    rows = F.array(*[F.struct(F.lit(p).alias("plane"), F.lit(a).alias("width"), F.lit(b).alias("height"), F.substring("picture", at, n).alias("samples")) for p, a, b, at, n in cuts])
    return decoded.where("picture is not null").select("path", "frame_no", F.explode(rows).alias("x")).select("path", "frame_no", "x.*")


def similarity(pairs: DataFrame, a: str, b: str, width: int, height: int) -> DataFrame:
    """``pairs`` with ssim: the mean structural similarity of luma over 8x8 blocks. The windows are this engine's own choice."""
    import numpy as np

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pairs.schema.fields)
    at = pairs.columns.index(a), pairs.columns.index(b)

    def luma(picture: bytes) -> np.ndarray:
        rows = np.frombuffer(picture, np.uint8, width * height).reshape(height, width).astype(np.float64)
        rows = rows[: height // 8 * 8, : width // 8 * 8]
        return rows.reshape(height // 8, 8, width // 8, 8).swapaxes(1, 2).reshape(-1, 64)

    def one(x, y) -> float | None:
        if x is None or y is None:
            return None
        x, y = luma(x), luma(y)
        mx, my = x.mean(1), y.mean(1)
        cov = (x * y).mean(1) - mx * my
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        return float(np.mean((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (x.var(1) + y.var(1) + c2))))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [one(x.as_py(), y.as_py()) for x, y in zip(batch.column(at[0]), batch.column(at[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "ssim"])

    return pairs.mapInArrow(batches, f"{fields}, ssim double")


def version_tag(version: Column | str) -> Column:
    """A version with a named stage in the form that package tools order: 1.2-alpha.3 as 1.2a3."""
    version = F.col(version) if isinstance(version, str) else version
    out = version
    for name, letter in (("-alpha.", "a"), ("-beta.", "b"), ("-rc.", "rc")):
        out = F.replace(out, F.lit(name), F.lit(letter))
    return out
