"""Whole pictures: decoding, verifying and encoding groups of pictures in parallel.

A predicted picture needs the one before it, so a group of pictures is one task's work, picture by
picture; groups, files and streams run side by side. Only one picture and its
predecessor are held at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.codecs import motion, residual, transform
from framelake.codecs.bits import Malformed
from framelake.functions import exprs as E

DECODED = "path string, frame_no long, pts_us long, frame_type int, codec int, picture binary, crc_ok boolean, error string"


def decode_one(payload: bytes, codec: int, kind: int, width: int, height: int, previous: bytes | None, meta: int = 0) -> bytes:
    """The picture of one frame record: 0 key, 1 predicted, 2 repeat."""
    if kind == 2:
        if previous is None:
            raise Malformed("repeat without a picture before it")
        return previous
    if kind == 1 and previous is None:
        raise Malformed("predicted picture without one before it")
    if 3 <= codec <= 6:
        shift = tuple((v & 255 ^ 128) - 128 for v in (meta, meta >> 8))
        return residual.decode(payload, width, height, previous, kind == 0, shift)
    if codec in (7, 8, 9):
        if kind == 0 or codec == 7:
            return transform.decode_intra(payload, width, height, previous if kind else None)
        return transform.decode_inter(payload, width, height, previous)
    raise Malformed(f"no decoder for generation {codec}")


def _values(column: pa.Array) -> Iterator:
    return (v.as_py() for v in column)


def decode(frames: DataFrame, headers: DataFrame, strict: bool = False) -> DataFrame:
    """One row per frame: the picture, whether its checksum holds, and the error if there is none.

    After an error the rest of the group has no picture, unless ``strict``, which raises.
    """
    w = Window.partitionBy("path").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    sized = headers.select("path", "width", "height")
    df = frames.where("error is null").withColumn("gop", F.count_if(F.col("frame_type") == 0).over(w)).join(sized, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, previous, broken = None, None, None
        for batch in batches:
            for r in (dict(zip(batch.schema.names, values)) for values in zip(*(_values(c) for c in batch.columns))):
                if group != (r["path"], r["gop"]):
                    group, previous, broken = (r["path"], r["gop"]), None, None
                error, picture = broken, None
                if not broken:
                    try:
                        picture = decode_one(r["payload"], r["codec"], r["frame_type"], r["width"], r["height"], previous, r["meta"] or 0)
                    except Malformed as e:
                        if strict:
                            raise
                        error, broken = str(e), "after an error in its group"
                previous = picture
                ok = None if picture is None else zlib.crc32(picture) == r["crc32"]
                yield pa.RecordBatch.from_pydict({
                    "path": [r["path"]], "frame_no": [r["frame_no"]], "pts_us": [r["pts_us"]], "frame_type": pa.array([r["frame_type"]], pa.int32()), "codec": pa.array([r["codec"]], pa.int32()),
                    "picture": pa.array([picture], pa.binary()), "crc_ok": pa.array([ok], pa.bool_()), "error": pa.array([error], pa.string()),
                })

    # a group stays together and in order; pictures stream through, none of them is gathered
    return df.repartition("path", "gop").sortWithinPartitions("path", "gop", "frame_no").mapInArrow(run, DECODED)


def verify(decoded: DataFrame) -> DataFrame:
    """Frames, and those without a picture or with a wrong checksum, of each file."""
    bad = F.coalesce(~F.col("crc_ok"), F.lit(True))
    return decoded.groupBy("path").agg(F.count("*").alias("frames"), F.count_if(bad).alias("bad_frames"), F.min(F.when(bad, F.col("frame_no"))).alias("first_bad"))


RECORDS = "path string, frame_no long, pts_us long, frame_type int, codec int, meta int, raw_size long, crc32 long, payload binary"


@dataclass(frozen=True)
class Settings:
    """How pictures are encoded: generation, quality, distance of forced key pictures, scene score from which a
    picture is a key picture, reach of the motion search and finalists that are looked at closely."""

    codec: int = 9
    quality: int = 78
    keyint: int = 120
    scene: float = 30.0
    reach: int = 4
    finalists: int = 1

    @classmethod
    def preset(cls, name: str, codec: int = 9) -> Settings:
        _, quality, keyint, scene, finalists = next(p for p in E.PRESETS if p[0] == name)
        return cls(codec, quality, keyint, float(scene), finalists=finalists)


class Encoder:
    """One stream, picture by picture; what was decoded last and the samples of the last source are all it keeps."""

    def __init__(self, width: int, height: int, settings: Settings):
        self.width, self.height, self.s = width, height, settings
        self.previous: bytes | None = None
        self.samples = None

    def kind(self, picture: bytes, forced: bool) -> int:
        """0 key, 1 predicted, 2 repeat.

        The oldest generation repeats equal pictures only, the next one what hardly differs from the decoded picture before;
        later ones compare a picture with the source of the one before. A scene is told from the decoded one.
        """
        if forced or self.previous is None:
            return 0
        score = lambda other: motion.scene_score(motion.scene_samples(picture, self.width, self.height), other)
        before = motion.scene_samples(self.previous, self.width, self.height)
        if self.s.codec == 3:
            same = picture == self.previous
        elif self.s.codec == 4:
            same = score(before) <= motion.at_quality(self.s.quality, E.REPEAT_PLAIN)
        else:
            same = score(self.samples) <= motion.at_quality(self.s.quality, E.REPEAT_FAST)
        return 2 if same else 1 if score(before) < self.s.scene else 0

    def encode(self, picture: bytes, forced: bool = False) -> tuple[int, int, bytes, bytes]:
        """(kind, packed global vector, payload, decoded picture)"""
        w, h, s = self.width, self.height, self.s
        if s.codec in (3, 4, 6):
            picture = motion.quantized_picture(picture, w, h, s.quality)
        kind, meta = self.kind(picture, forced), 0
        if kind == 2:
            payload, seen = b"", self.previous
        elif s.codec > 6:
            if kind == 0 or s.codec == 7:
                payload, seen = transform.encode_intra(picture, w, h, s.quality, self.previous if kind else None)
            else:
                vectors = motion.search_vectors(picture, self.previous, w, h, s.quality, s.reach, s.finalists)
                payload, seen = transform.encode_inter(picture, w, h, s.quality, self.previous, vectors, bit_coded=s.codec == 9)
        elif kind == 0:
            rest, seen = residual.row_residual(picture, w, h), picture
            payload = residual.wrap(residual.pack_blocks(rest)) if s.codec == 6 else residual.pack_grouped(rest, s.codec == 4)
        else:
            payload, seen, meta = self._predicted(picture)
        self.previous, self.samples = seen, motion.scene_samples(picture, w, h)
        return kind, meta, payload, seen

    def _predicted(self, picture: bytes) -> tuple[bytes, bytes, int]:
        w, h, s = self.width, self.height, self.s
        new, old = motion.luma(picture, w, h), motion.luma(self.previous, w, h)
        meta, vectors = 0, None
        if s.codec == 6:
            vectors = motion.block_motion(new, old, s.reach, s.quality) if s.reach else None
            moved = self.previous if vectors is None else residual.moved_picture(self.previous, w, h, vectors)
            dead, step = (motion.at_quality(s.quality, t) for t in (E.DEAD_ZONE_FAST, E.RESIDUAL_STEPS))
        else:
            dx, dy = motion.global_motion(new, old, s.reach, "plain" if s.codec == 3 else "guarded")
            meta, moved = dx & 255 | (dy & 255) << 8, motion.shifted(self.previous, w, h, (dx, dy))
            dead, step = (0 if s.codec == 3 else motion.at_quality(s.quality, E.DEAD_ZONE_PLAIN)), 1
        rest = motion.quantized_difference(picture, moved, dead, step)
        seen = ((np.frombuffer(moved, np.uint8).astype(int) + np.frombuffer(rest, np.uint8)) % 256).astype(np.uint8).tobytes()
        payload = residual.pack_predicted(rest, w, h, vectors) if s.codec == 6 else residual.pack_grouped(rest, s.codec == 4, s.codec == 4)
        return payload, seen, meta


def encode(pictures: DataFrame, width: int, height: int, codec: int = 9, quality: int = 78, keyint: int = 120, fps: tuple[int, int] = (30, 1), settings: Settings | None = None) -> DataFrame:
    """Frame records of pictures (path, frame_no, picture): key, predicted and repeated pictures as ``Encoder`` decides.

    Every ``keyint``-th picture is a key picture, after which nothing of the ones before is needed, so the pictures between are one
    task's work and stream through it one by one.
    """
    settings = settings or Settings(codec, quality, keyint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, encoder = None, None
        for batch in batches:
            for path, n, picture, gop in zip(*(batch.column(i) for i in range(4))):
                path, n, gop = path.as_py(), n.as_py(), gop.as_py()
                if group != (path, gop):
                    group, encoder = (path, gop), Encoder(width, height, settings)
                kind, meta, payload, seen = encoder.encode(picture.as_py(), n % settings.keyint == 0)
                yield pa.RecordBatch.from_pydict({
                    "path": [path], "frame_no": [n], "pts_us": [n * fps[1] * 1_000_000 // fps[0]], "frame_type": pa.array([kind], pa.int32()), "codec": pa.array([settings.codec], pa.int32()),
                    "meta": pa.array([meta], pa.int32()), "raw_size": [width * height * 3 // 2], "crc32": [zlib.crc32(seen)], "payload": pa.array([payload], pa.binary()),
                })

    keyed = pictures.select("path", "frame_no", "picture", F.expr(f"frame_no div {settings.keyint}").alias("gop"))
    return keyed.repartition("path", "gop").sortWithinPartitions("path", "gop", "frame_no").mapInArrow(run, RECORDS)
