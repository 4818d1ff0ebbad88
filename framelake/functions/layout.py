"""Little-endian records as binary columns: packing and parsing in expressions, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import exprs as E

# Field names and sizes in bytes of the file header, and of a frame record.
HEADER = [
    ("major", 1), ("minor", 1), ("header_size", 2), ("flags", 4), ("width", 4), ("height", 4), ("fps_num", 4), ("fps_den", 4), ("frame_count", 4), ("keyint", 4), ("quality", 4),
    ("audio_rate", 4), ("audio_channels", 2), ("audio_codec", 2), ("audio_samples", 8), ("frames_offset", 8), ("audio_offset", 8), ("index_offset", 8), ("duration_us", 8),
]
RECORD = [("frame_no", 4), ("pts_us", 8), ("frame_type", 1), ("codec", 1), ("meta", 2), ("raw_size", 4), ("packed_size", 4), ("crc32", 4)]
HEADER_SIZE, RECORD_SIZE, ENTRY_SIZE = 96, 32, 16
LARGEST_PAYLOAD = 512 << 20


def little(value: Column, size: int) -> Column:
    """A number of 0 or more as hex digits of ``size`` bytes, the lowest byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def number(data: Column, at: int | Column, size: int) -> Column:
    """The number of ``size`` bytes at a place (from 0) of a binary; null past its end."""
    at = E.col(at)
    part = F.substring(data, at + 1, F.lit(size))
    digits = F.hex(part)
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.when(F.octet_length(part) == size, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def pack(mark: bytes, fields: list[tuple[str, int]], values: dict[str, Column], size: int) -> Column:
    """A record as binary: its mark, its fields, and zeros up to its size."""
    rest = size - len(mark) - sum(n for _, n in fields)
    return F.unhex(F.concat(F.lit(mark.hex().upper()), *[little(values[name], n) for name, n in fields], F.lit("00" * rest)))


def parse(data: Column, fields: list[tuple[str, int]], at: int = 4) -> dict[str, Column]:
    """The fields of a record, after a mark of 4 bytes, as longs; numbers past the range of a long are null."""
    out = {}
    for name, n in fields:
        out[name] = number(data, at, n).try_cast("long")
        at += n
    return out


def header_fault(data: Column) -> Column:
    """What is wrong with a file's header; null if nothing is."""
    h = parse(data, HEADER)
    odd = (h["width"] % 2 + h["height"] % 2 > 0) | (h["width"] == 0) | (h["height"] == 0) | (h["fps_num"] == 0) | (h["fps_den"] == 0)
    return (
        F.when(F.substring(data, 1, 4) == F.lit(b"GVID"), "retired container").when((F.octet_length(data) < HEADER_SIZE) | (F.substring(data, 1, 4) != F.lit(b"GHV1")), "no container")
        .when(h["header_size"] != HEADER_SIZE, "bad header size").when(odd, "bad picture size or rate").when(F.greatest(*[v.isNull() for v in h.values()]), "number out of range")
    )


def pack_index(entries: Column) -> Column:
    """An index as binary, of an array of structs (offset, frame_type)."""
    rows = F.transform(entries, lambda e: F.concat(little(e["offset"], 8), little(e["frame_type"], 1), F.lit("00" * 7)))
    return F.unhex(F.concat(F.lit(b"INDX".hex().upper()), little(F.size(entries), 4), F.array_join(rows, "")))


def parse_index(data: Column) -> Column:
    """The entries (offset, frame_type) of an index; null if it has no mark or is cut off."""
    n = number(data, 4, 4).cast("int")
    entry = lambda i: F.struct(number(data, 8 + i * ENTRY_SIZE, 8).cast("long").alias("offset"), number(data, 16 + i * ENTRY_SIZE, 1).cast("int").alias("frame_type"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when((F.substring(data, 1, 4) == F.lit(b"INDX")) & (F.octet_length(data) == 8 + n * ENTRY_SIZE), F.transform(places, entry))


def record_fault(mark_ok: Column, frame_type: Column, codec: Column, frame_no: Column, expected: Column, packed_size: Column, end: Column, file_size: Column) -> Column:
    """The first rule that a frame record breaks; null if it keeps all."""
    rules = [
        (mark_ok, "no record mark"), (frame_type.between(0, 2), "bad frame type"), (codec.between(3, 9), "unknown generation"), (frame_no == expected, "number out of sequence"),
        (packed_size <= LARGEST_PAYLOAD, "payload too large"), (end <= file_size, "past the end of the file"),
    ]
    out = None
    for fine, name in rules:
        bad = ~F.coalesce(fine, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def audio_fault(channels: Column, bits: Column, block: Column, rate: Column) -> Column:
    """What is wrong with sound parameters; null if nothing is."""
    return F.when(~channels.isin(1, 2), "channels").when(~bits.isin(6, 8), "bits").when((block < 8) | (block > 1024), "block").when(rate <= 0, "rate")
