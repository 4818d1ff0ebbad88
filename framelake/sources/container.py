"""Media containers as tables: a Python Data Source, one input partition per group of pictures.

``spark.read.format("framelake").option("table", ...).load(path)`` reads one of

* ``header``: one row per file; ``index``: its frame index; ``records``: frame records without payload
  (the payloads are skipped over, not read); ``frames``: frame records with payload; ``audio``: the
  audio record; ``scan``: records found from the start, without the index, for repair; ``stream``: frames of an
encoder's raw stream (options ``fps_num`` and ``fps_den``).

``frames`` and ``records`` push a filter on frame_no down to the groups of pictures that can
hold it. The driver only lists files: a large one is read in as many parts as its size asks for, and each part finds
its groups of pictures in the index itself. ``mode`` is ``failfast`` or ``permissive`` (a bad file or record is a row with ``error``).
"""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from framelake.codecs.bits import Malformed

# Record layouts and marks of the format.
HEADER = struct.Struct("<4sBBHIIIIIIIIIHHQQQQQ8s")
RECORD = struct.Struct("<4sIQBBHIII")
INDEX_HEAD, INDEX_ENTRY = struct.Struct("<4sI"), struct.Struct("<QB7x")
AUDIO_RECORD = struct.Struct("<4sIQQ")
AUDIO_HEADER = struct.Struct("<4sBBH4sIHHIIQQQ12s")
STREAM_HEAD, STREAM_RECORD = struct.Struct("<4sIIII"), struct.Struct("<BbbBIII")
STREAM_MARKS = {b"GHS6": 6, b"GHS7": 7, b"GHS8": 8, b"GHS9": 9}
FILE_MARK, OLD_MARK, RECORD_MARK, AUDIO_MARK, INDEX_MARK = b"GHV1", b"GVID", b"VFRM", b"AUD0", b"INDX"
AUDIO_FILE_MARK, AUDIO_CODEC = b"GHAF", b"GHA1"
LARGEST_PAYLOAD = 512 << 20
COPIED = 4 << 20
FIELDS = (
    "major minor header_size flags width height fps_num fps_den frame_count keyint quality audio_rate audio_channels audio_codec audio_samples "
    "frames_offset audio_offset index_offset duration_us"
).split()
SCHEMAS = {
    "header": "path string, " + ", ".join(f"{f} long" for f in FIELDS) + ", file_size long, error string",
    "index": "path string, frame_no long, offset long, frame_type int, error string",
    "records": "path string, frame_no long, pts_us long, frame_type int, codec int, meta int, raw_size long, packed_size long, crc32 long, offset long, error string",
    "frames": "path string, frame_no long, pts_us long, frame_type int, codec int, meta int, raw_size long, packed_size long, crc32 long, offset long, payload binary, error string",
    "audio": "path string, codec long, samples long, payload binary, error string",
}
SCHEMAS["scan"], SCHEMAS["stream"] = SCHEMAS["records"], SCHEMAS["frames"]


def parse_header(data: bytes) -> dict:
    if len(data) >= 4 and data[:4] == OLD_MARK:
        raise Malformed("a container of the first, retired generation")
    if len(data) < HEADER.size or data[:4] != FILE_MARK:
        raise Malformed("no container")
    h = dict(zip(FIELDS, HEADER.unpack(data[: HEADER.size])[1:-1]))
    if h["header_size"] != HEADER.size:
        raise Malformed("bad header size")
    if h["width"] % 2 or h["height"] % 2 or not h["width"] or not h["height"] or not h["fps_num"] or not h["fps_den"]:
        raise Malformed("bad picture size or rate")
    if max(h.values()) >= 1 << 63:
        raise Malformed("number out of range")
    return h


def pack_header(h: dict) -> bytes:
    return HEADER.pack(FILE_MARK, *(int(h[f]) for f in FIELDS), bytes(8))


def read_index(f, h: dict) -> list[tuple[int, int]]:
    f.seek(h["index_offset"])
    head = f.read(INDEX_HEAD.size)
    if len(head) < INDEX_HEAD.size or head[:4] != INDEX_MARK:
        raise Malformed("no index")
    n = INDEX_HEAD.unpack(head)[1]
    body = f.read(n * INDEX_ENTRY.size)
    if n != h["frame_count"] or len(body) != n * INDEX_ENTRY.size:
        raise Malformed("index doesn't fit the frame count")
    entries = list(INDEX_ENTRY.iter_unpack(body))
    if any(kind > 2 for _, kind in entries):
        raise Malformed("bad frame type in index")
    return entries


def read_record(f, at: int, size: int, payload: bool) -> tuple:
    f.seek(at)
    head = f.read(RECORD.size)
    if len(head) < RECORD.size or head[:4] != RECORD_MARK:
        raise Malformed(f"no frame record at {at}")
    _, no, pts, kind, codec, meta, raw, packed, crc = RECORD.unpack(head)
    if kind > 2 or not 3 <= codec <= 9 or packed > LARGEST_PAYLOAD or at + RECORD.size + packed > size:
        raise Malformed(f"bad frame record at {at}")
    body = ()
    if payload:
        body = (f.read(packed),)
    return (no, pts, kind, codec, meta, raw, packed, crc, at, *body)


def scan_records(f, h: dict, size: int) -> Iterator[tuple]:
    """Records from the first on, payloads skipped, up to the first that is no record in sequence."""
    at, expected = h["frames_offset"], 0
    while True:
        try:
            row = read_record(f, at, size, False)
        except Malformed:
            return
        if row[0] != expected:
            return
        yield row
        expected += 1
        at += RECORD.size + row[6]


def stream_records(f, size: int, fps: tuple[int, int]) -> Iterator[tuple]:
    """Frame records, with payload, of an encoder's raw stream, which has no index and no times."""
    head = f.read(STREAM_HEAD.size)
    if len(head) < STREAM_HEAD.size or head[:4] not in STREAM_MARKS:
        raise Malformed("no raw stream")
    mark, version, width, height, raw = STREAM_HEAD.unpack(head)
    if version != STREAM_MARKS[mark] or raw != width * height * 3 // 2:
        raise Malformed("bad raw stream head")
    n = 0
    while record := f.read(STREAM_RECORD.size):
        at = f.tell() - len(record)
        if len(record) < STREAM_RECORD.size:
            raise Malformed("truncated record")
        kind, dx, dy, _, raw, packed, crc = STREAM_RECORD.unpack(record)
        if kind > 2 or packed > LARGEST_PAYLOAD or f.tell() + packed > size:
            raise Malformed(f"bad record at {at}")
        yield n, n * fps[1] * 1_000_000 // fps[0], kind, version, dx & 255 | (dy & 255) << 8, raw, packed, crc, at, f.read(packed)
        n += 1


@dataclass
class Part(InputPartition):
    """Part ``number`` of ``of`` of a file: the groups of pictures of its share of the index."""

    path: str
    number: int = 0
    of: int = 1


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/*") if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path = options.get("table", "frames"), options["path"]
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.low, self.high = 0, 1 << 62
        self.part_bytes = int(options.get("part_bytes", 64 << 20))
        self.fps = int(options.get("fps_num", 30)), int(options.get("fps_den", 1))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if getattr(x, "attribute", None) == ("frame_no",) and self.table in ("frames", "records"):
                if isinstance(x, EqualTo):
                    self.low, self.high = max(self.low, x.value), min(self.high, x.value)
                elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, x.value)
                elif isinstance(x, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, x.value)
            yield x  # groups of pictures are coarser than the filter

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in files_of(self.path):
            n = 1
            if self.table in ("frames", "records"):
                n = max(1, -(-os.path.getsize(path) // self.part_bytes)) if os.path.exists(path) else 1
            parts += [Part(path, i, n) for i in range(n)]
        return parts

    def _offsets(self, f, h: dict, part: Part) -> Iterator[int]:
        """Where the records stand of this part's groups of pictures that can hold a wanted number."""
        entries = read_index(f, h)
        starts = [i for i, (_, kind) in enumerate(entries) if kind == 0 or i == 0]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(entries)])):
            if i * part.of // max(len(starts), 1) == part.number and a <= self.high and b > self.low:
                yield from (offset for offset, _ in entries[a:b])

    def _failed(self, path: str, error: Exception | str) -> tuple:
        if not self.permissive:
            raise Malformed(f"{path}: {error}")
        return (path, *[None] * (len(SCHEMAS[self.table].split(",")) - 2), str(error))

    def read(self, part: Part) -> Iterator[tuple]:
        path = part.path
        try:
            size = os.path.getsize(path)
            f = open(path, "rb")
        except OSError as e:
            yield self._failed(path, e)
            return
        with f:
            try:
                if self.table in ("frames", "records"):
                    for at in self._offsets(f, parse_header(f.read(HEADER.size)), part):
                        yield (path, *read_record(f, at, size, self.table == "frames"), None)
                    return
                if self.table == "stream":
                    yield from ((path, *row, None) for row in stream_records(f, size, self.fps))
                    return
                h = parse_header(f.read(HEADER.size))
                if self.table == "header":
                    yield (path, *(h[x] for x in FIELDS), size, None)
                elif self.table == "index":
                    yield from ((path, i, o, k, None) for i, (o, k) in enumerate(read_index(f, h)))
                elif self.table == "scan":
                    yield from ((path, *row, None) for row in scan_records(f, h, size))
                elif h["flags"] & 1:
                    f.seek(h["audio_offset"])
                    mark, codec, n, samples = AUDIO_RECORD.unpack(f.read(AUDIO_RECORD.size))
                    if mark != AUDIO_MARK or f.tell() + n > size:
                        raise Malformed("bad audio record")
                    yield (path, codec, samples, f.read(n), None)
            except (Malformed, struct.error) as e:
                yield self._failed(path, e)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: list


class Writer(DataSourceWriter):
    """Frame records to one container. Tasks write parts beside it, in a folder that the driver sees as well; the commit knows
    all sizes, so offsets are computed before a byte of the file is written, and nothing is patched. One file is one
    sequence of bytes, so the parts are copied together in one place, in pieces of a few MB."""

    def __init__(self, options: dict, schema):
        self.options, self.target = options, options["path"].removeprefix("file://")
        self.names = schema.fieldNames()

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(os.path.dirname(self.target) or ".", exist_ok=True)
        part, held = f"{self.target}.part-{uuid.uuid4().hex}", []
        with open(part, "wb") as f:
            for row in rows:
                r = row.asDict()
                body = bytes(r["payload"] or b"")
                held.append((r["frame_no"], r["frame_type"], f.tell(), RECORD.size + len(body)))
                f.write(RECORD.pack(RECORD_MARK, r["frame_no"], r["pts_us"], r["frame_type"], r["codec"], r["meta"] or 0, r["raw_size"], len(body), r["crc32"]) + body)
        return Written(part, held)

    def commit(self, messages) -> None:
        records = sorted((no, kind, m.path, at, n) for m in messages if m for no, kind, at, n in m.rows)
        h = {f: int(self.options.get(f, 0)) for f in FIELDS}
        sizes = sum(r[4] for r in records)
        h |= {"major": 0, "minor": h["minor"] or 9, "header_size": HEADER.size, "frame_count": len(records), "frames_offset": HEADER.size, "index_offset": HEADER.size + sizes, "fps_den": h["fps_den"] or 1}
        h["duration_us"] = len(records) * h["fps_den"] * 1_000_000 // max(h["fps_num"], 1)
        whole, at, entries = f"{self.target}.new-{uuid.uuid4().hex}", HEADER.size, []
        parts = {m.path: open(m.path, "rb") for m in messages if m}
        with open(whole, "wb") as out:
            out.write(pack_header(h))
            for _, kind, path, start, n in records:
                parts[path].seek(start)
                for k in range(0, n, COPIED):  # a piece at a time, however large a payload is
                    out.write(parts[path].read(min(COPIED, n - k)))
                entries.append((at, kind))
                at += n
            out.write(INDEX_HEAD.pack(INDEX_MARK, len(entries)) + b"".join(INDEX_ENTRY.pack(*e) for e in entries))
        self.abort(messages)
        shutil.move(whole, self.target)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class Container(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelake"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "frames")]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Container)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str = "frames", mode: str = "failfast") -> DataFrame:
    register(spark)
    return spark.read.format("framelake").option("table", table).option("mode", mode).load(path)


def pack_audio_file(blocks: bytes, rate: int, channels: int, bits: int, frames: int, block: int = 32, quality: int = 0) -> bytes:
    n = -(-frames // block)
    return AUDIO_HEADER.pack(AUDIO_FILE_MARK, 0, 2, AUDIO_HEADER.size, AUDIO_CODEC, rate, channels, bits, block, quality, frames, n, AUDIO_HEADER.size, bytes(12)) + blocks


def parse_audio_header(data: bytes) -> dict:
    names = "mark major minor header_size codec rate channels bits block quality frames blocks data_offset rest".split()
    if len(data) < AUDIO_HEADER.size:
        raise Malformed("truncated audio header")
    h = dict(zip(names, AUDIO_HEADER.unpack(data[: AUDIO_HEADER.size])))
    if h["mark"] != AUDIO_FILE_MARK or h["codec"] != AUDIO_CODEC or h["data_offset"] != AUDIO_HEADER.size:
        raise Malformed("no audio file")
    if h["channels"] not in (1, 2) or h["bits"] not in (6, 8) or not 8 <= h["block"] <= 1024 or h["blocks"] != -(-h["frames"] // h["block"]):
        raise Malformed("bad audio parameters")
    return h


def write_wav(path: str, rate: int, pcm) -> None:
    """(frames, channels) 16-bit samples as a WAV file."""
    import wave

    with wave.open(path, "wb") as f:
        f.setnchannels(pcm.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm.astype("<i2").tobytes())
