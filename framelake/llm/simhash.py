"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.shared import first_rows, row_key, shuffled, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned integer.

    Words are runs of non-whitespace (ASCII) bytes, A-Z lower-cased. Every occurrence of a
    shingle counts. A text with fewer words than a shingle has one shingle of all of them;
    a text without words, or null, has fingerprint zero.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])]
        ones += _ones(np.array(hashes, np.uint64))
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set that is given as 64-bit hashes, as a signed integer; that of the empty set is zero."""
    ones = sum((_ones(hashes[i : i + (1 << 16)]) for i in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint's 64 bits as a long."""
    kept = docs.select(*(keep or []), F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            column = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "fp"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fp long"])
    return kept.mapInArrow(batches, schema)


#: The values of the Hamming ball of radius 1 around a segment ``v`` of ``w`` bits.
BALL = "explode(concat(array(v), transform(sequence(0, w - 1), i -> v ^ shiftleft(1L, i))))"


def _entries(fps: DataFrame, segments: int) -> DataFrame:
    """(fp, seg, w, v): the segments of each fingerprint, their widths and values."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    part = lambda a, b: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long"))
    cut = [F.struct(F.lit(i).alias("seg"), F.lit(b - a).alias("w"), part(a, b).alias("v")) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return fps.select("fp", F.explode(F.array(*cut)).alias("e")).select("fp", "e.seg", "e.w", "e.v")


def _probed(fps: DataFrame, segments: int) -> DataFrame:
    """(fp, n, lo, hi) of the table rows that each fingerprint meets with the values of the Hamming balls of radius 1
    around its segments: a row's size, smallest and largest member. Rows that hold the fingerprint alone are left out."""
    entries = _entries(fps, segments)
    rows = entries.groupBy("seg", "v").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    probes = entries.select("fp", "seg", F.expr(BALL).alias("v"))
    return written(
        shuffled(probes, rows, ["seg", "v"]).where("not (n = 1 and lo = fp)").select("fp", "n", "lo", "hi"), "probes"
    )


def _filed(fps: DataFrame) -> DataFrame:
    """As ``_probed`` for fingerprints that differ by up to two bits in a 32-bit half: each is filed under all values of
    the balls of radius 1 around its halves, and two such balls share a value. A row of two is given once."""
    row = Window.partitionBy("seg", "v")
    filed = _entries(fps, 2).select("fp", "seg", F.expr(BALL).alias("v"))
    rows = filed.select("fp", F.count("*").over(row).alias("n"), F.min("fp").over(row).alias("lo"), F.max("fp").over(row).alias("hi"))
    return written(rows.where("n > 2 or (n = 2 and fp = lo)"), "probes")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def segments_for(n: int) -> int:
    """How many segments, 2 to 4, leave each about eight values or more for one of ``n`` fingerprints."""
    return min(4, max(2, 64 // (n.bit_length() + 3)))


def near_fingerprints(fps: DataFrame, segments: int) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints ``fp`` at less than twice as many differing bits as there are
    segments: such two differ by at most one bit in one of them.

    The values of three segments are so few (2^21) that up to eight unrelated fingerprints meet each one in its balls, a
    number that grows with the table. At that reach, up to 5 bits, two differ by at most two bits in one of two halves
    as well, so they meet in tables of halves, with as many entries and 2^32 values. Members of larger rows there, which
    are wider, are few and go to the tables of three segments by themselves. Four segments are for small tables.

    Every such pair that meets in a table row of up to two members; fingerprints that meet larger rows are connected
    at 2 or fewer bits, as in ``fingerprint_links``. So pairs don't grow with the square of a row; who needs all of
    those at more bits has to find the rest another way.
    """
    reach = 2 * segments - 1
    if segments != 3:
        return _linked(_probed(fps, segments), reach)
    met = _filed(fps)
    apart = written(met.where("n > 2").select("fp").distinct(), "apart")
    return _pairs(met, reach).union(_linked(_probed(apart, segments), reach)).distinct()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints ``fp`` at 2 or fewer
    differing bits: every such pair is linked directly or through others.

    Two fingerprints at distance 2 or less differ by at most one bit in one of two 32-bit
    segments. Each fingerprint enters the table of each segment under that segment's value,
    and probes both tables with the 33 values of the segment's Hamming ball of radius 1;
    what the tables return is verified on all 64 bits. A table row holds its size, smallest
    and largest member, which are all its members up to two. A fingerprint that probes a
    larger row is set aside: pairs read from such a row would grow with its square. Both ends of
    any link through a larger row are set aside (each is a member of it or probes it), and
    two of those are within 2 bits exactly if both are within one bit of some 64-bit value, so each is
    filed under its 65 values of the full ball and linked to the smallest fingerprint there.
    """
    return _linked(_probed(fps, 2), 2)


def _pairs(found: DataFrame, reach: int) -> DataFrame:
    """Links (src, dst) at ``reach`` or fewer bits of what the probes found in rows of up to two members."""
    return (
        found.where("n <= 2")
        .select("fp", F.explode(F.array("lo", "hi")).alias("other"))
        .where((F.col("fp") != F.col("other")) & (_distance("fp", "other") <= reach))
        .select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    )


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """Links (src, dst) at ``reach`` or fewer bits of what the probes found in rows of up to two members, and at 2 or
    fewer bits, through full balls of radius 1, of the fingerprints that met larger rows."""
    apart = found.where("n > 2").select("fp").distinct()
    balls = apart.select(
        "fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))").alias("z")
    )
    centre = balls.groupBy("z").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    large = (
        shuffled(balls, centre, "z")
        .where((F.col("fp") != F.col("lo")) & (_distance("fp", "lo") <= 2))
        .select(F.col("fp").alias("src"), F.col("lo").alias("dst"))
    )
    return _pairs(found, reach).union(large).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id, fp, component_id), the smallest id reachable by
    links at 2 or fewer differing bits.

    Null and empty texts have fingerprint zero and link like any other. A null id takes
    part, and is smallest only in a group that has no other id. Repeated rows come back
    repeated; further columns are ignored; an empty table gives an empty table.
    """
    prints = written(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle, ["id"]), "fps")
    named = shuffled(_components(prints), prints.groupBy("fp").agg(F.min("id").alias("first")), "fp")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = shuffled(named, least, "component").select("fp", "component_id")
    return shuffled(prints, named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _components(prints: DataFrame) -> DataFrame:
    """(fp, component) of each distinct fingerprint: the least fingerprint that links reach."""
    distinct = written(prints.select("fp").distinct(), "distinct")
    groups = connected_components(fingerprint_links(distinct))
    return shuffled(distinct, groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, of one id that of the least text
    and row hash, and of equal rows one. A null id is smallest only in a group that has no other; rows are
    told apart by what they hold, so one whose id another row has as well is not lost with it."""
    at = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("dh"), row_key(docs).alias("rh"), F.col(text).alias("text"))
    prints = written(with_fingerprints(at, "text", shingle, ["id", "dh", "rh"]), "fps")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "dh", "rh")).alias("first"))
    return first_rows(docs, shuffled(_components(prints), first, "fp").select(F.col("component").alias("group"), "first"), text)
