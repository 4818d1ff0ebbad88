"""Line deduplication by a segment-partition edit join.

Two lines within edit distance k, cut into k + 1 segments, share a segment at nearly the
same place. Every line is filed under (its length, segment number, segment) and looks up
the substrings of lines as long or up to k shorter that could be such a segment. Hashes
of all substrings come from prefix sums over whole batches of text. Keys travel as packed arrays, dealt to
shards by hash; a shard sorts them and hands out pairs of lines, whose texts are fetched
and verified by a banded bit-parallel edit distance.

A key that very many lines share (templates, families of near copies) would give pairs with the square
of their number. Its lines are set aside and joined, still whole, by finer keys: what is left
of the line without one place. Lines that share such a key are within one edit of each other, so a
star to the least of them links them all, and no pair is listed. That holds for one edit; for a threshold of
more the lines of such a key meet in blocks, each with each other, and a pair of blocks only gives the links that connect its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.ngram import pack, unpack
from framelake.llm.shared import written
from framelake.llm.tokens import ROOT, ROOT_INVERSE, mix, pair

#: Lines shorter than EXACT_FROM characters are left alone; from NEAR_FROM on, edits count.
THRESHOLD, EXACT_FROM, NEAR_FROM = 1, 10, 20
#: Pairs that one key may give; beyond that its lines are joined by finer keys.
MOST_PAIRS = 4096
#: Characters of text, and keys, that are worked on at a time.
SLICE, KEYS = 1 << 19, 1 << 19
#: Keys that a shard aims at; keys of a line at a threshold of 1; lines that a block holds.
SHARD, KEYS_EACH, BLOCK = 1 << 21, 6, 256
SALTS = 16


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two texts, or ``most`` + 1 if it is larger: bit-parallel, in a band
    of 2 * most + 1 diagonals that slides along the pattern."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if a == b or not most:
        return 0 if a == b else 1
    if len(a) <= most:
        return _plain(a, b, most)
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = (full << (width - most - 1)) & full, 0
    distance, start, across = most, most + 1 - width, top >> 1
    for i, c in enumerate(b):
        found = places.get(c, 0)
        found = (found >> start if start >= 0 else found << -start) & full
        d0 = ((((found & up) + up) & full) ^ up) | found | down
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        if i < len(a) - most:
            distance += not d0 & top
        else:
            distance += bool(hp & across) - bool(hn & across)
            across >>= 1
        up = (hn | ~((d0 >> 1) | hp)) & full
        down = (d0 >> 1) & hp
        start += 1
    return min(distance, most + 1)


def _plain(a: str, b: str, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row[-1], most + 1)


class Lines:
    """The lines of some texts: places in one array of code points, and substring hashes."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(points == 10)
        self.starts = np.concatenate(([0], breaks + 1)).astype(np.int64)
        self.ends = np.append(breaks, len(points)).astype(np.int64)
        counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        n = len(points) + 1
        steps = np.full(n, ROOT, np.uint64)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = ROOT_INVERSE
        self.down = np.multiply.accumulate(steps)
        self.up = up
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])
        self.length = self.ends - self.starts
        self.hash = self.of(self.starts, self.ends)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


def line_slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about SLICE characters; null is empty."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def segment_bounds(length: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the k + 1 segments of lines of these lengths: even, the longer ones last."""
    short, longer = length // (k + 1), length % (k + 1)
    at, out = np.zeros_like(length), []
    for i in range(k + 1):
        size = short + (i >= k + 1 - longer)
        out.append((at, size))
        at = at + size
    return out


def segment_keys(lines: Lines, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line hash, 1 for what is filed and 0 for what is looked up)."""
    which = np.flatnonzero(lines.length >= NEAR_FROM)
    which = which[np.unique(lines.hash[which], return_index=True)[1]]
    start, length, own = lines.starts[which], lines.length[which], lines.hash[which]
    keys, owners, filed = [], [], []

    def add(at, size, of_length, i, kind, mask=slice(None)):
        head = pair(of_length.astype(np.uint64), np.full(len(at), i, np.uint64))
        keys.append(pair(head, lines.of(start[mask] + at, start[mask] + at + size)))
        owners.append(own[mask])
        filed.append(np.full(len(at), kind, np.uint64))

    for i, (at, size) in enumerate(segment_bounds(length, k)):
        add(at, size, length, i, 1)
    for less in range(k + 1):
        of_length = length - less
        for i, (at, size) in enumerate(segment_bounds(of_length, k)):
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                fits = (at + shift >= 0) & (at + shift + size <= length) & (of_length >= NEAR_FROM)
                add(at[fits] + shift, size[fits], of_length[fits], i, 0, fits)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(filed)


def without_one(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line hash, kind) by which lines within one edit of each other meet.

    Kind 1: the line without one place, and the place; lines that share it differ by one
    substitution. Kind 2: the line without one place; kind 0: the line. A 2 that meets a 0 is one
    deletion; two lines that only share a 2 may be two edits apart.
    """
    keys, owners, kinds = [], [], []
    whole = np.full(1, 1 << 40, np.uint64)
    for s, e, own in zip(lines.starts, lines.ends, lines.hash):
        p = np.arange(s, e)
        n = np.uint64(max(e - s - 1, 0))
        rest = mix(lines.raw(np.full(len(p), s), p) + lines.raw(p + 1, np.full(len(p), e)) * lines.up[p - s] + n)
        keys += [pair(rest, (p - s).astype(np.uint64)), pair(rest, whole), pair(np.array([own]), whole)]
        owners.append(np.full(2 * len(p) + 1, own, np.uint64))
        kinds.append(np.repeat(np.array([1, 2, 0], np.uint64), [len(p), len(p), 1]))
    return tuple(np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (keys, owners, kinds))


def _packed(shards: np.ndarray, n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((arrays[0], shards))
    arrays = [a[order] for a in arrays]
    bounds = np.searchsorted(shards[order], np.arange(n + 1))
    held = np.flatnonzero(np.diff(bounds))
    blobs = [pack(*(a[bounds[s] : bounds[s + 1]] for a in arrays)) for s in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def line_table(docs: DataFrame) -> DataFrame:
    """(id, dh, line, h, size): the lines of texts (id, dh, text) of at least EXACT_FROM characters."""
    kind = docs.schema["id"].dataType.simpleString()

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in line_slices(batch.column(2).to_pylist()):
                lines = Lines(texts)
                held = np.flatnonzero(lines.length >= EXACT_FROM)
                rows = pa.array(lines.text[held] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines.number[held], pa.int32()), _signed(lines.hash[held]), pa.array(lines.length[held], pa.int32())],
                    names=["id", "dh", "line", "h", "size"],
                )

    return docs.select("id", "dh", "text").mapInArrow(batches, f"id {kind}, dh long, line int, h long, size int")


def candidate_pairs(docs: DataFrame, k: int, shards: int) -> DataFrame:
    """(a, b, null) of line hashes that share a key; (a, null, key) for the lines of a key too common."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, texts in line_slices(batch.column(0).to_pylist()):
                parts.append(segment_keys(Lines(texts), k))
                size += len(parts[-1][0])
                if size > KEYS:
                    yield _emit(parts)
                    parts, size = [], 0
        if parts:
            yield _emit(parts)

    def _emit(parts: list) -> pa.RecordBatch:
        key, own, filed = (np.concatenate(x) for x in zip(*parts))
        return _packed((key >> np.uint64(40)).astype(np.int64) % shards, shards, key, own, filed)

    def match(key: tuple, group: pa.Table) -> pa.Table:
        key, own, filed = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in group.column("blob"))))
        order = np.lexsort((own, filed, key))
        key, own, filed = key[order], own[order], filed[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (filed[1:] != filed[:-1])))
        key, own, filed = key[once], own[once], filed[once]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(start[1:], len(key))
        table = np.add.reduceat(filed.astype(np.int64), start)
        looks = end - start - table
        several = (table > 0) & (looks > 0) & (end - start > 1)
        common = several & (table * looks > MOST_PAIRS)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s, e, t in zip(start[several & ~common], end[several & ~common], table[several & ~common]):
            left, right = own[s : e - t], own[e - t : e]
            a.append(np.repeat(left, len(right)))
            b.append(np.tile(right, len(left)))
        a, b = np.concatenate(a), np.concatenate(b)
        differ = a != b
        a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        size = (end - start)[common]
        alone = np.concatenate([*(own[s:e] for s, e in zip(start[common], end[common])), np.zeros(0, np.uint64)])
        left = np.concatenate([pairs[:, 0], alone])
        right = pa.concat_arrays([_signed(pairs[:, 1]), pa.nulls(len(alone), pa.int64())])
        keys_of = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), _signed(np.repeat(key[start[common]], size))])
        return pa.table({"a": _signed(left), "b": right, "key": keys_of})

    blobs = docs.select("text").mapInArrow(keys, "shard int, blob binary")
    return blobs.groupBy("shard").applyInArrow(match, "a long, b long, key long")


def finer_links(texts: DataFrame, k: int, shards: int) -> DataFrame:
    """Links (a, b) of all lines (text) within one edit, by the keys of without_one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in line_slices(batch.column(0).to_pylist()):
                key, own, kind = without_one(Lines(part))
                yield _packed((key >> np.uint64(40)).astype(np.int64) % shards, shards, key, own, kind)

    def star(key: tuple, group: pa.Table) -> pa.Table:
        key, own, kind = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in group.column("blob"))))
        order = np.lexsort((own, kind, key))
        key, own, kind = key[order], own[order], kind[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        links = np.unique(np.stack([own[head], own], 1)[(own != own[head]) & (kind[head] < 2)], axis=0)
        return pa.table({"a": _signed(links[:, 0]), "b": _signed(links[:, 1])})

    return texts.select("text").mapInArrow(keys, "shard int, blob binary").groupBy("shard").applyInArrow(star, "a long, b long")


def connecting(ids: list[int], texts: list[str], side: list[int], k: int) -> tuple[list[int], list[int]]:
    """Links that connect what pairs within ``k`` edits of the two sides (of one, if there is one) connect."""
    root, cross, a, b = list(range(len(ids))), any(side), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(range(len(ids)), key=lambda i: len(texts[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(texts[j]) - len(texts[i]) > k:
                break
            if (not cross or side[i] != side[j]) and find(i) != find(j) and edit_distance(texts[i], texts[j], k) <= k:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
                a.append(ids[i])
                b.append(ids[j])
    return a, b


def blocked_links(texts: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Links (a, b) of the lines (key, h) of common keys within ``k`` edits: blocks of a key's lines, each with each."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("key", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))

    def compare(group: pa.Table) -> pa.Table:
        a, b = connecting(*(group.column(c).to_pylist() for c in ("h", "text", "side")), k)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return own.join(texts, "h").select("key", "i", "j", "side", "h", "text").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def texts_of(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line text) of the wanted line hashes, each read from the first text that holds it."""
    # a line is reduced to its first place before it meets the wanted ones, however often it stands
    first = lines.groupBy("h").agg(F.min(F.struct("id", "dh", "line")).alias("p")).join(wanted, "h", "left_semi")
    places = first.groupBy("p.id", "p.dh").agg(F.collect_list(F.struct("h", "p.line")).alias("lines"))
    places = places.withColumnRenamed("id", "pid").withColumnRenamed("dh", "pdh")
    held = docs.join(places, docs["id"].eqNullSafe(places["pid"]) & (docs["dh"] == places["pdh"]))
    held = held.dropDuplicates(["id", "dh"]).select(F.split("text", "\n", -1).alias("all"), F.explode("lines").alias("l"))
    return held.select(F.col("l.h").alias("h"), F.element_at("all", F.col("l.line") + 1).alias("text"))


def near_links(docs: DataFrame, lines: DataFrame, k: int = THRESHOLD) -> DataFrame:
    """Links (a, b) of line hashes that connect all distinct lines within ``k`` edits."""
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() * KEYS_EACH * k * k // SHARD)
    found = written(candidate_pairs(docs, k, shards), "linepairs")
    pairs = written(found.where("b is not null").select("a", "b").distinct(), "linepairs")
    members = found.where("b is null").select("key", F.col("a").alias("h")).distinct()
    common = members.select("h").distinct()
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(common).distinct()
    texts = written(texts_of(docs, lines, wanted), "linetexts")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([edit_distance(s, t, k) <= k for s, t in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    near = both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")
    if k > 1:
        return near.union(blocked_links(texts, members, k))
    return near.union(finer_links(texts.join(common, "h", "left_semi"), k, shards))


def _marked(lines: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``lines`` with the columns of ``few`` (one row per line hash) where the hash is there.

    One line may be a third of all; the side with few rows is dealt to SALTS places, so its
    occurrences are as well.
    """
    dealt = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "dh", "line"), F.lit(SALTS)).cast("int")
    return lines.withColumn("__salt", salt).join(dealt, [key, "__salt"], "left").drop("__salt")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = THRESHOLD) -> DataFrame:
    """(id, dh, removed, near): numbers of the lines, from 0, that each text loses, in order, and
    how many of them differ from the line kept.

    Lines of at least EXACT_FROM characters that are equal, or reach each other by steps of at most
    ``k`` edits between lines of NEAR_FROM characters or more, are one class; the class keeps
    its first line by id, text hash and line number. Rows of one id and text are one text. ``dh`` is the text's hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("dh"), F.col(text).alias("text"))
    lines = written(line_table(rows), "lines")
    classes = connected_components(near_links(rows, lines, k), "a", "b")
    classes = written(classes.select(F.col("node").alias("h"), F.col("component").alias("c")), "lineclasses")
    marked = _marked(lines, classes, "h").select("id", "dh", "line", "h", F.coalesce("c", "h").alias("c"))
    here = F.struct("id", "dh", "line")
    # A class may hold a third of all lines, so lines are not brought to their class: each
    # class is reduced to its first line before it travels, and every other line is lost.
    first = marked.groupBy("c").agg(F.min(here).alias("f"), F.min_by("h", here).alias("fh"))
    kept = first.select(F.col("f.id").alias("kid"), F.col("f.dh").alias("kdh"), F.col("f.line").alias("kline"))
    lost = marked.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("dh") == F.col("kdh")) & (F.col("line") == F.col("kline")), "left_anti")
    # lines of linked classes that differ from the one kept: one row per distinct line
    other = classes.join(first, "c").where("h <> fh").select("h", F.lit(True).alias("differs"))
    lost = _marked(lost, other, "h")
    return lost.groupBy("id", "dh").agg(F.array_sort(F.collect_set("line")).alias("removed"), F.size(F.collect_set(F.when(F.col("differs"), F.col("line")))).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: str | None = "n_chars", k: int = THRESHOLD) -> DataFrame:
    """``docs`` without the lines of removed_lines; the column ``size``, if there, is the new
    text's length. A text that loses all its lines stays as an empty text; null stays null."""
    lost = removed_lines(docs, id_col, text, k).select(F.col("id").alias("__id"), F.col("dh").alias("__dh"), F.col("removed").alias("__removed"))
    joined = docs.join(lost, docs[id_col].eqNullSafe(lost["__id"]) & (F.xxhash64(docs[text]) == lost["__dh"]), "left")
    left = F.array_join(F.filter(F.split(docs[text], "\n", -1), lambda _, i: ~F.array_contains("__removed", i)), "\n")
    new = F.when(F.col("__removed").isNull(), docs[text]).otherwise(left)
    out = []
    for c in docs.columns:
        if c == text:
            out.append(new.alias(c))
        elif c == size:
            out.append(F.when(F.col("__removed").isNull(), docs[c]).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(docs[c])
    return joined.select(*out)


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, n_near (removed, and not equal to
    the line kept), removed (line numbers, comma-joined). A null text has no line."""
    lost = removed_lines(docs, id_col, text, k).select(F.col("id").alias("__id"), F.col("dh").alias("__dh"), "removed", "near")
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("dh"), F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(lost, rows[id_col].eqNullSafe(lost["__id"]) & (rows["dh"] == lost["__dh"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(rows[id_col], "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))
