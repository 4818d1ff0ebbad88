"""Interpolated modified Kneser-Ney n-gram scoring, of any order from 2 on.

Counting: words are 64-bit hashes. Every task reduces its n-grams to distinct ones with
counts, deals them by context to shards (a context too frequent for one shard is dealt by the whole
n-gram), and each shard becomes sorted hash arrays in files of the shared folder. What a shard holds of
distinct n-grams is counted by their last n - 1 words, and so on down to single words: the lower orders
count what stands before, not how often. Scoring
tasks map those files into memory and look up whole batches of words by binary search,
shard by shard; nothing of the model travels with the tasks but the list of its files and
a few numbers.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import shared_dir, written
from framelake.llm.tokens import BEGIN, END, mix, pair, text_slices, words

#: Words of an n-gram, unless a caller asks for more; the disk that higher orders take is in the README.
ORDER = 2
#: Tokens that a task counts before it hands on; entries that a shard aims at; bytes of text for one token, at least.
CHUNK, SHARD, TOKEN_BYTES = 4 << 20, 4 << 20, 6
#: A context of two or more words is looked at as too frequent for a shard where it is this share of a chunk.
HEAVY = 4096
SUMMARY = "shard int, path string, n long, total long, stats array<long>, hot binary"


# Files of arrays ---------------------------------------------------------------------

def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """The arrays one after the other in a new file, with a header of types and lengths.

    The name is new for each attempt, so a task that runs twice harms nothing.
    """
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    head = len(head).to_bytes(4, "little") + head
    head += b"\0" * (-len(head) % 16)
    name = f"{name}-{uuid.uuid4().hex}"
    body = [head] + [x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 16))]
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            f.writelines(body)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{name}") as f:
            for part in body:
                f.write(part)
    return f"{folder}/{name}"


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped. A file in a store that can't be mapped is copied to a
    nameless scratch file first, which goes with the process."""
    if local := _local(path):
        whole = np.memmap(local, np.uint8, "r")
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        scratch = tempfile.TemporaryFile()
        with store.open_input_stream(at) as f:
            while part := f.read(1 << 22):
                scratch.write(part)
        scratch.flush()
        whole = np.memmap(scratch, np.uint8, "r")
    size = int.from_bytes(whole[:4].tobytes(), "little")
    head, at, arrays = whole[4 : 4 + size].tobytes().decode(), -(-(4 + size) // 16) * 16, []
    for kind, n in (x.split(",") for x in head.split(";")):
        dtype, n = np.dtype(kind), int(n)
        arrays.append(whole[at : at + n * dtype.itemsize].view(dtype))
        at += -(-n * dtype.itemsize // 16) * 16
    return arrays


# What travels between the stages: sorted, compressed blobs ---------------------------

def _varied(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each at its least width; those sorted in the caller's order shrink by their differences."""
    out = io.BytesIO()
    for a in arrays:
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        a = np.diff(a, prepend=np.uint64(0)) if rising else a
        a = _varied(a)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else a.view(np.uint8)
        body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        out.write(bytes([a.dtype.itemsize, rising]) + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return out.getvalue()


def unpack(blob: bytes) -> list[np.ndarray]:
    arrays, at = [], 0
    while at < len(blob):
        width, rising = blob[at], blob[at + 1]
        n, size = (int.from_bytes(blob[at + i : at + i + 8], "little") for i in (2, 10))
        body = zstandard.ZstdDecompressor().decompress(blob[at + 18 : at + 18 + size], max_output_size=n * width)
        a = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)
        arrays.append(np.cumsum(a, dtype=np.uint64) if rising else a)
        at += 18 + size
    return arrays


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and, for each array of values, its sums by key."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[at], *(np.add.reduceat(v[order], at) for v in values)]


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _dealt(shards: np.ndarray, n: int, make) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) for shards in rising order; make(slice) gives the blob's bytes."""
    bounds = np.searchsorted(shards, np.arange(n + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), make(slice(bounds[s], bounds[s + 1]))


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes with an end after each text, tokens of each text) of slices of texts."""
    for _, _, data, offsets in text_slices(column):
        h, _, _, counts = words(data, offsets)
        out = np.full(len(h) + len(counts), END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)] = h
        yield out, counts + 1


def _contexts(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each token the hashes of the 1, 2, ..., order - 1 tokens before it in its text; BEGIN stands before the first."""
    at = np.arange(len(tokens))
    first = np.repeat(np.cumsum(counts) - counts, counts)
    before = lambda d: np.where(at - d >= first, tokens[np.maximum(at - d, 0)], BEGIN)
    out = [before(1)]
    for d in range(2, order):
        out.append(pair(before(d), out[-1]))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], of) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays that of(tokens, counts) makes, joined up to about CHUNK tokens."""
    parts, n = [], 0
    for batch in batches:
        for tokens, counts in _tokens(batch.column(0)):
            parts.append(of(tokens, counts))
            n += len(tokens)
            if n >= CHUNK:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, n = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


# Counting ----------------------------------------------------------------------------

def _summary(shard: int, path: str, n: int, total: int, stats, hot: bytes = b"") -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "stats": pa.array([[int(x) for x in stats]], pa.list_(pa.int64())), "hot": pa.array([hot], pa.binary())})


def count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; where a count of counts is zero, its
    formula is undefined and the discount is half the count it applies to (at most 1)."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(d, 0.0), float(i)) for i, d in zip((1, 2, 3), raw))


def _merge_words(folder: str):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = [unpack(b.as_py()) for b in group.column("blob")]
        h, c = summed(*(np.concatenate(x) for x in zip(*parts)))
        return _summary(shard, write_arrays(folder, f"words-{shard}", [h, c]), len(h), int(c.sum()), [])

    return merge


def _distinct(contexts: list[np.ndarray], w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(key, contexts, last word, summed count) of distinct n-grams in the order of their keys."""
    key = pair(contexts[0], w)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    c = np.add.reduceat(c[order], at) if len(at) else c[:0]
    return key[at], [x[order][at] for x in contexts], w[order][at], c


def _gram_blobs(key: np.ndarray, contexts: list[np.ndarray], w: np.ndarray, c: np.ndarray, hot: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """(shard, blob) of n-grams: contexts are written once for all words that follow them."""
    s = gram_shard(contexts[0], key, hot, shards)
    order = np.lexsort((contexts[0], s))
    contexts, w, c, s = [x[order] for x in contexts], w[order], c[order], s[order]

    def blob(x: slice) -> bytes:
        v = contexts[0][x]
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        return pack(v[start], np.diff(np.append(start, len(v))).astype(np.uint64), *(y[x][start] for y in contexts[1:]), w[x], c[x])

    return list(_dealt(s, shards, blob))


def _unblob(blob: bytes) -> tuple[np.ndarray, ...]:
    v, runs, *rest, w, c = unpack(blob)
    return (*(np.repeat(x, runs.astype(np.int64)) for x in (v, *rest)), w, c)


def _hot_words(spark, rows: list, limit: float) -> np.ndarray:
    """The words that occur more than ``limit`` times, from the files of counted words."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                h, c = map_arrays(path)
                yield pa.RecordBatch.from_arrays([pa.array(h[c > limit].view(np.int64), pa.int64())], names=["h"])

    files = spark.createDataFrame([(r["path"],) for r in rows], "path string")
    return np.array([r["h"] for r in files.mapInArrow(found, "h long").collect()], np.int64).view(np.uint64)


def _hot_contexts(texts: DataFrame, k: int, limit: float) -> np.ndarray:
    """The contexts of k - 1 words that occur more than ``limit`` times, of those that are a HEAVY-th of some chunk."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (v,) in _chunks(batches, lambda t, n: (_contexts(t, n, k)[-1],)):
            h, c = summed(v, np.ones(len(v), np.uint64))
            keep = c * np.uint64(HEAVY) > len(v)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["h", "n"])

    rows = texts.mapInArrow(found, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def train(docs: DataFrame, text: str = "text", folder: str | None = None, order: int = ORDER) -> dict:
    """The model of the texts of ``docs``: its files and its few numbers.

    Null and empty texts count as texts of no words. An empty table gives a model that
    knows no word. Before the first word of a text stand as many marks as the order asks for.
    """
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ngram-{uuid.uuid4().hex}"
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TOKEN_BYTES // SHARD)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tokens,) in _chunks(batches, lambda t, _: (t,)):
            h, c = summed(tokens, np.ones(len(tokens), np.uint64))
            order = np.lexsort((h, shard_of(h, partitions)))
            h, c = h[order], c[order]
            yield _blobs(list(_dealt(shard_of(h, partitions), partitions, lambda x: pack(h[x], c[x]))))

    rows = texts.mapInArrow(words_of, "shard int, blob binary").groupBy("shard").applyInArrow(_merge_words(folder), SUMMARY).collect()
    n_tokens, n_words = sum(r["total"] for r in rows), sum(r["n"] for r in rows)
    word_files = {r["shard"]: r["path"] for r in rows}
    shards = max(partitions, -(-n_tokens // SHARD))
    # A context of more than half a shard's share of all tokens is dealt by the whole n-gram.
    limit = n_tokens / shards / 2
    begin = np.array([BEGIN], np.uint64)
    hot = {2: np.sort(np.concatenate([_hot_words(spark, rows, limit), begin]))}
    for k in range(3, order + 1):
        begin = pair(np.array([BEGIN], np.uint64), begin)
        hot[k] = np.unique(np.concatenate([_hot_contexts(texts, k, limit), begin]))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, *contexts in _chunks(batches, lambda t, n: (t, *reversed(_contexts(t, n, order)))):
            yield _blobs(_gram_blobs(*_distinct(contexts, w, np.ones(len(w), np.uint64)), hot[order], shards))

    def merge(k: int):
        def merged(key: tuple, group: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            *contexts, w, c = (np.concatenate(x) for x in zip(*(_unblob(b.as_py()) for b in group.column("blob"))))
            keys, contexts, w, c = _distinct(contexts, w, c)
            one = np.uint64(1)
            context = summed(contexts[0], c, (c == 1) * one, (c == 2) * one, (c > 2) * one)
            large = np.flatnonzero(c > 254)
            arrays = [keys, np.minimum(c, 255).astype(np.uint8), large.astype(np.uint64), c[large], context[0], *(_varied(x) for x in context[1:])]
            path = write_arrays(folder, f"grams{k}-{shard}", arrays)
            is_hot = np.isin(context[0], hot[k])
            table = _summary(shard, path, len(keys), int(c.sum()), count_of_counts(c), pack(*(x[is_hot] for x in context)))
            # rows of the second kind, dealt to the shards of the next order: how many words stand before an n-gram of one word less
            if k > 2:
                extra = _gram_blobs(*_distinct(contexts[1:], w, np.ones(len(w), np.uint64)), hot[k - 1], shards)
            else:
                last, m = summed(w, np.ones(len(w), np.uint64))
                order = np.lexsort((last, shard_of(last, partitions)))
                last, m = last[order], m[order]
                extra = [(s, b) for s, b in _dealt(shard_of(last, partitions), partitions, lambda x: pack(last[x], m[x]))]
            empty = lambda kind: pa.nulls(len(extra), kind)
            return pa.concat_tables([table, pa.table({"shard": pa.array([s for s, _ in extra], pa.int32()), "path": empty(pa.string()), "n": empty(pa.int64()), "total": empty(pa.int64()), "stats": empty(pa.list_(pa.int64())), "hot": pa.array([b for _, b in extra], pa.binary())})])

        return merged

    blobs, levels = texts.mapInArrow(grams_of, "shard int, blob binary"), []
    for k in range(order, 1, -1):
        table = written(blobs.groupBy("shard").applyInArrow(merge(k), SUMMARY), f"grams{k}")
        rows = table.where("path is not null").collect()
        parts = [p for p in (unpack(r["hot"]) for r in rows) if len(p[0])]
        levels.append({
            "k": k, "files": {r["shard"]: r["path"] for r in rows}, "distinct": sum(r["n"] for r in rows), "hot": hot[k],
            "hot_contexts": summed(*(np.concatenate(x) for x in zip(*parts))) if parts else [np.zeros(0, np.uint64)] * 5,
            "discounts": discounts([sum(r["stats"][i] for r in rows) for i in range(4)]),
        })
        blobs = table.where("path is null").select("shard", F.col("hot").alias("blob"))

    def merge_continuations(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        h, c = map_arrays(word_files[shard])
        last, m = summed(*(np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in group.column("blob")))))
        count = np.zeros(len(h), np.uint64)
        count[np.searchsorted(h, last)] = m
        return _summary(shard, write_arrays(folder, f"known-{shard}", [h, _varied(c), _varied(count)]), len(h), 0, count_of_counts(count))

    rows = blobs.groupBy("shard").applyInArrow(merge_continuations, SUMMARY).collect()
    return {
        "order": order, "words": {r["shard"]: r["path"] for r in rows}, "word_shards": partitions, "shards": shards, "levels": levels[::-1], "tokens": n_tokens, "vocabulary": n_words,
        "distinct_bigrams": levels[-1]["distinct"], "d1": discounts([sum(r["stats"][i] for r in rows) for i in range(4)]), "followed": _lower_counts(rows),
    }


def _lower_counts(rows) -> list[int]:
    """Words that follow one, two, or more distinct words."""
    n1, n2 = sum(r["stats"][0] for r in rows), sum(r["stats"][1] for r in rows)
    return [n1, n2, sum(r["n"] for r in rows) - n1 - n2]


def gram_shard(v: np.ndarray, key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    return shard_of(np.where(hot[at] == v, key, mix(v)), n)


# Scoring -----------------------------------------------------------------------------

_open: dict[str, list[np.ndarray]] = {}


def _arrays(path: str) -> list[np.ndarray]:
    if path not in _open:
        _open[path] = map_arrays(path)
    return _open[path]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _by_shard(keys: np.ndarray, shards: np.ndarray, files: dict[int, str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places of the keys in key order, the shard's arrays) for each shard that holds any."""
    order = np.lexsort((keys, shards))
    s = shards[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    for a, b in zip(at, np.append(at[1:], len(s))):
        if path := files.get(int(s[a])):
            yield order[a:b], _arrays(path)


def token_scores(model: dict, tokens: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(training count, log10 probability) of each token after those before it, from one word up to the model's order."""
    distinct, inverse = np.unique(tokens, return_inverse=True)
    c, cont = np.zeros(len(distinct)), np.zeros(len(distinct))
    for place, (h, counts, continuations) in _by_shard(distinct, shard_of(distinct, model["word_shards"]), model["words"]):
        at, ok = _found(h, distinct[place])
        c[place], cont[place] = counts[at] * ok, continuations[at] * ok
    d1, d2, d3 = model["d1"]
    n1, n2, n3 = model["followed"]
    total = model["distinct_bigrams"]
    if not total:
        return c[inverse], np.zeros(len(tokens))
    lower = np.maximum(cont - np.choose(np.minimum(cont, 3).astype(int), [0, d1, d2, d3]), 0) / total
    lower += (d1 * n1 + d2 * n2 + d3 * n3) / total / (model["vocabulary"] + 1)
    p = lower[inverse]
    for level, before in zip(model["levels"], contexts):
        high, back = _level(level, model["shards"], tokens, before)
        p = high + back * p
    return c[inverse], np.log10(p)


def _level(level: dict, shards: int, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token what its own n-gram gives, and the weight of the order below; 0 and 1 after a context that is unknown."""
    e1, e2, e3 = level["discounts"]
    key = pair(before, tokens)
    shard = gram_shard(before, key, level["hot"], shards)
    high, back = np.zeros(len(key)), np.ones(len(key))
    hot, *hot_sums = level["hot_contexts"]
    if len(hot):
        at, ok = _found(hot, before)
        s, m1, m2, m3 = (x[at].astype(float) for x in hot_sums)
        back = np.where(ok, (e1 * m1 + e2 * m2 + e3 * m3) / np.maximum(s, 1), 1.0)
        high = np.where(ok, 1 / np.maximum(s, 1), 0.0)
    for place, (keys, counts, large, true, contexts, s, m1, m2, m3) in _by_shard(key, shard, level["files"]):
        v = before[place]
        at, ok = _found(contexts, v)
        if len(hot):
            ok &= ~_found(hot, v)[1]
        sums = s[at][ok].astype(float)
        back[place[ok]] = (e1 * m1[at][ok] + e2 * m2[at][ok] + e3 * m3[at][ok]) / sums
        high[place[ok]] = 1 / sums
        at, ok = _found(keys, key[place])
        n = counts[at].astype(float) * ok
        over = n == 255
        if over.any():
            n[over] = true[np.searchsorted(large, at[over].astype(np.uint64))]
        high[place] *= np.maximum(n - np.choose(np.minimum(n, 3).astype(int), [0, e1, e2, e3]), 0)
    high[~np.isin(shard, np.fromiter(level["files"], np.int64))] = 0
    return high, back


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``extra``, n_tokens, n_known (seen in
    training), train_tokens, base_score (smoothed unigram) and score (the model), both log10.

    The end of a text is a token. A null or empty text has that one token. Repeated rows
    come back repeated; ids may be null; an empty model gives every token probability 1.
    """
    extra = extra or {}
    kept = docs.select(F.col(text).alias("__text"), F.col(id_col), *(c.alias(k) for k, c in extra.items()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            n_tokens, n_known, base, full = [], [], [], []
            for tokens, counts in _tokens(batch.column(0)):
                c, p = token_scores(model, tokens, _contexts(tokens, counts, model["order"]))
                at = np.concatenate(([0], np.cumsum(counts)[:-1]))
                n_tokens.append(counts)
                n_known.append(np.add.reduceat((c > 0).astype(np.int64), at))
                unigram = np.log10((c + 0.1) / (model["tokens"] + 0.1 * (model["vocabulary"] + 1)))
                base.append(np.add.reduceat(unigram, at))
                full.append(np.add.reduceat(p, at))
            names = names or [*batch.schema.names[1:], "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            if batch.num_rows:
                columns = [np.concatenate(x) for x in (n_tokens, n_known, base, full)]
                columns.insert(2, np.full(batch.num_rows, model["tokens"], np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, columns)], names=names)

    return kept.mapInArrow(batches, ", ".join([*fields, "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))
