"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased; punctuation and spacing don't
count. Every n-gram of a test item that occurs in a text is a seed hit. A seed is rare if
its words, drawn one by one at their shares of all words of the corpus, would rarely
stand together; the rarer half of an item's seeds counts as rare in any case. Copies of a passage don't
make its seeds less rare, so one that a third of all texts copied is found as well.
Passages with a rare hit are aligned with the item, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import forget, text_key, written
from framelake.llm.tokens import NOT_WORD, pair, text_slices, words

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item is found where the alignment has this share of the score of a perfect copy.
LEAST_SCORE = 0.5
#: Benchmark n-grams that are matched in one pass over the texts; more make more passes.
BLOCK = 1 << 17
#: A seed whose words meet by chance at most this often, per place, is rare.
CHANCE = 1e-8
PASSAGE = "id {id}, item int, seeds array<long>, words binary"


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; of all words if there are fewer."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = pair(out, h[i : len(h) - n + 1 + i])
    return out


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        h, _, _, counts = words(data, offsets, NOT_WORD)
        out += np.split(h, np.cumsum(counts)[:-1])
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of a local alignment of two word sequences, and the length
    of the passage up to its end. A row at a time; gaps along the row by a running maximum."""
    best, end = 0, 0
    steps = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


class Seeds:
    """The n-grams of a block of items, sorted, with the items they stand in."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.ids = n, [i for i, _ in items]
        self.items = word_hashes([t for _, t in items])
        self.lengths = np.array([len(h) for h in self.items], np.int64)
        grams = [ngrams(h, n) for h in self.items]
        key = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (item[1:] != item[:-1]))) if len(key) else np.zeros(0, bool)
        self.key, self.item = key[once], item[once]
        self.vocabulary = np.unique(np.concatenate([*self.items, np.zeros(0, np.uint64)]))
        #: A bit per 22 leading bits: most of a text's n-grams and words end here.
        self.maybe, self.maybe_word = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.maybe[_lead(self.key)] = True
        self.maybe_word[_lead(self.vocabulary)] = True
        self.short = np.unique(self.lengths[(self.lengths > 0) & (self.lengths < n)])

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a text, places in the seeds) of all hits on a text's n-grams."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in [self.n, *self.short.tolist()]:
            if len(h) >= n:
                g = ngrams(h, n)
                at = np.flatnonzero(self.maybe[_lead(g)])
                low = np.searchsorted(self.key, g[at], "left")
                many = np.searchsorted(self.key, g[at], "right") - low
                places.append(np.repeat(at, many))
                found.append(np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        return np.concatenate(places), np.concatenate(found)

    def count(self, h: np.ndarray, counts: np.ndarray) -> None:
        """Adds the occurrences of the items' words."""
        h = h[self.maybe_word[_lead(h)]]
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        counts += np.bincount(at[self.vocabulary[at] == h], minlength=len(counts))

    def rare(self, counts: np.ndarray, total: int, chance: float) -> list[set[int]]:
        """The rare seeds of each item, given how often each of its words stands in the corpus."""
        log = np.log(np.maximum(counts, 1) / max(total, 1))
        out = []
        for h in self.items:
            g = ngrams(h, self.n)
            each = log[np.searchsorted(self.vocabulary, h)]
            n = min(self.n, len(h))
            sums = np.convolve(each, np.ones(n), "valid") if n else np.zeros(0)
            out.append(set(g[(sums <= np.log(chance)) | (sums <= np.median(sums))].view(np.int64).tolist()) if n else set())
        return out


def _lead(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def _passages(seeds: Seeds, texts: pa.Array, counts: np.ndarray) -> Iterator[tuple]:
    """(row, item, seed hashes, word hashes) of each passage with a hit.

    Hits of one item that stand no further apart than twice the item's length share a
    passage, which reaches the item's length to both sides; it grows no longer than the
    run of hits.
    """
    for a, b, data, offsets in text_slices(texts):
        all_h, _, _, sizes = words(data, offsets, NOT_WORD)
        counts[-1] += len(all_h)
        seeds.count(all_h, counts[:-1])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for i in range(b - a):
            h = all_h[bounds[i] : bounds[i + 1]]
            at, which = seeds.hits(h)
            if not len(at):
                continue
            item = seeds.item[which]
            order = np.lexsort((at, item))
            at, which, item = at[order], which[order], item[order]
            cut = np.flatnonzero((item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * seeds.lengths[item[1:]])) + 1
            for x, y in zip(np.concatenate(([0], cut)), np.append(cut, len(at))):
                reach = int(seeds.lengths[item[x]])
                passage = h[max(0, int(at[x]) - reach) : int(at[y - 1]) + seeds.n + reach]
                yield a + i, int(item[x]), np.unique(seeds.key[which[x:y]]), passage


def _batch(kind: pa.DataType, ids: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[3].tobytes() for r in rows], pa.binary())],
        names=["id", "item", "seeds", "words"],
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = NGRAM, least: float = LEAST_SCORE, chance: float = CHANCE, block: int = BLOCK,
) -> DataFrame:
    """Rows (id, item_id, score): the best alignment of each text with each test item that it
    holds, as a share of a perfect copy's score, where it is at least ``least``.

    The items are read in blocks of about ``block`` words, each matched in one pass over all
    texts; its result is written before the next block is read, so one block is held at a time. Items without words, and null or empty texts, match nothing; of rows with one id
    the best counts, so a repeated text has one row per item. Null ids come back null; empty tables give
    an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], f"id {kind}, item_id {item_kind}, score double")
    for seeds in _blocks(items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")), n, block):
        out = out.union(_matched(pairs, seeds, kind, item_kind, least, chance))
    best = out.groupBy("id", "item_id").agg(F.max("score").alias("score"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id), "score")


def _matched(pairs: DataFrame, seeds: Seeds, kind: str, item_kind: str, least: float, chance: float) -> DataFrame:
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(seeds)  # a block, so of bounded size

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, id_type = shared.value, None
        counts = np.zeros(len(seeds.vocabulary) + 1, np.int64)
        for batch in batches:
            id_type, rows, ids = batch.schema.field(0).type, [], batch.column(0)
            for row in _passages(seeds, batch.column(1), counts):
                rows.append(row)
                if len(rows) == 2000:
                    yield _batch(id_type, ids.take(pa.array([r[0] for r in rows])).to_pylist(), rows)
                    rows = []
            if rows:
                yield _batch(id_type, ids.take(pa.array([r[0] for r in rows])).to_pylist(), rows)
        if id_type is not None:  # last, what this task has counted: words as seeds, counts as words
            held = np.flatnonzero(counts)
            yield _batch(id_type, [None], [(0, -1, held.astype(np.uint64), counts[held])])

    found = written(pairs.mapInArrow(passages, PASSAGE.format(id=kind)), "passages")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words_of, counts in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(words_of.as_py(), pa.int64()), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["word", "n"])

    # one row per word of the block
    counted = found.where("item = -1").select("seeds", "words").mapInArrow(pieces, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(seeds.vocabulary) + 1, np.int64)
    for row in counted.collect():
        counts[row["word"]] = row["n"]
    rare = seeds.rare(counts[:-1], int(counts[-1]), chance)
    known = spark.sparkContext.broadcast((seeds.ids, seeds.items, rare))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, rare = known.value
        for batch in batches:
            rows, got = [], []
            for i, (item, hits, body) in enumerate(zip(*(batch.column(k) for k in (1, 2, 3)))):
                item = item.as_py()
                if rare[item].isdisjoint(hits.as_py()):
                    continue
                score = align(items[item], np.frombuffer(body.as_py(), np.uint64))[0] / (MATCH * len(items[item]))
                if score >= least:
                    rows.append(i)
                    got.append((names[item], score))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["id", "item_id", "score"])

    scored = written(found.where("item >= 0").mapInArrow(scores, f"id {kind}, item_id {item_kind}, score double"), "scores")
    shared.destroy()
    known.destroy()
    forget(found)
    return scored


def _blocks(items: DataFrame, n: int, block: int) -> Iterator[Seeds]:
    """The items with words, in blocks of about ``block`` words, one block held at a time."""
    part, size = [], 0
    for row in items.where("t is not null").distinct().toLocalIterator():
        part.append((row["i"], row["t"]))
        size += len(row["t"].split())
        if size >= block:
            yield Seeds(part, n)
            part, size = [], 0
    if part:
        yield Seeds(part, n)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item. The text alone decides, so null and
    repeated ids do no harm; null and empty texts stay."""
    own = docs.select(text_key(text).alias("__key"), F.col(text).alias("__text"))
    bad = contaminated(own, items, "__key", "__text", **options).select("__key").distinct()
    return docs.withColumn("__key", text_key(text)).join(bad, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
