"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common letter subsequences of length 3, each weighed
down by the letters it spans, so gaps and inserted letters lessen a match but don't end
it. A power of the normalised kernel (a product of kernels is one) tells near forms from chance
likeness. A text is the bag of its words, and its features are the kernel values of its words
with the landmarks, summed, made orthonormal by the landmarks' own kernel matrix and divided
by a power of the text's length. A linear support vector machine on them is, for each
word, one number; scoring a text adds up its words' numbers.

Labels are there for whole texts only, so a text's sentences are one labelled bag.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.tokens import text_slices, words

GAPS, DECAY, POWER = 3, 0.8, 4
LONGEST = 16
LANDMARKS = 96
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 4000
#: Values of words that a worker remembers; kernel terms that are computed at a time.
REMEMBER, TERMS = 1 << 19, 1 << 16

_not_letters = re.compile(r"[\W\d_]+")
_shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _shape(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a word of n letters, and their weights."""
    if n not in _shapes:
        places = [c for c in combinations(range(n), 3) if c[2] - c[0] <= 2 + GAPS] or [(0, min(1, n - 1), n - 1)]
        places = np.array(places)
        _shapes[n] = places, (DECAY ** (places[:, 2] - places[:, 0] - 2)).astype(np.float32)
    return _shapes[n]


def unit_of(token: str) -> str:
    """A token in lower case without what is no letter; at most LONGEST letters are compared at a time."""
    return _not_letters.sub("", token).lower()


def pieces(unit: str) -> list[str]:
    """A long word as overlapping pieces of LONGEST letters."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def text_tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable[[int], str]]]:
    """(texts, hash and text number of each token, a token's text by its place) of slices of texts.

    Tokens are split at ASCII whitespace; a run of three or more single characters is one more token.
    """
    for a, b, data, offsets in text_slices(column):
        h, starts, ends, counts = words(data, offsets)
        owner = np.repeat(np.arange(b - a), counts)
        extra: list[bytes] = []
        if len(h):
            first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            single = first[ends] - first[starts] == 1
            joins = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
            begin = np.flatnonzero(single & ~np.concatenate(([False], joins)))
            end = np.flatnonzero(single & ~np.concatenate((joins, [False]))) + 1
            runs = [(x, y) for x, y in zip(begin, end) if y - x > 2]
            extra = [b"".join(data[starts[i] : ends[i]].tobytes() for i in range(x, y)) for x, y in runs]
            if extra:
                line = np.frombuffer(b" ".join(extra), np.uint8)
                h = np.concatenate([h, words(line, np.array([0, len(line)]))[0]])
                owner = np.concatenate([owner, owner[[x for x, _ in runs]]])
        token = lambda i, d=data, s=starts, e=ends, x=extra: (d[s[i] : e[i]].tobytes() if i < len(s) else x[i - len(s)]).decode(errors="replace")
        yield b - a, h, owner, token


def _letters(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in units, code points of their letters), by length of the unit."""
    by: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by.setdefault(len(u), []).append(i)
    for n, which in by.items():
        if n:
            points = "".join([units[i] for i in which]).encode("utf-32-le", "surrogatepass")
            yield np.array(which), np.frombuffer(points, np.uint32).reshape(-1, n).astype(np.int64)


def _self(letters: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: squares of the summed weights of equal subsequences."""
    codes = (letters[:, places[:, 0]] << 42) | (letters[:, places[:, 1]] << 21) | letters[:, places[:, 2]]
    order = np.argsort(codes, axis=1)
    codes = np.take_along_axis(codes, order, 1)
    sums = np.cumsum(weights[order], axis=1, dtype=np.float64)
    last = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((len(codes), 1), bool)], axis=1)
    rows, columns = np.nonzero(last)
    ends = sums[rows, columns]
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    each = ends - np.where(first, 0, np.concatenate(([0], ends[:-1])))
    return np.bincount(rows, each * each, len(codes))


class Landmarks:
    """Landmark words, ready for kernels with many words."""

    def __init__(self, units: list[str]):
        self.units = units
        alphabet = sorted(set("".join(units)))
        #: Letters of no landmark are 0; they can't add to a common subsequence.
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.base = len(alphabet) + 1
        rows: dict[int, dict[int, float]] = {}
        for which, letters in _letters(units):
            places, weights = _shape(letters.shape[1])
            own = np.sqrt(_self(letters, places, weights))
            for i, codes, k in zip(which.tolist(), self._codes(letters, places).tolist(), own):
                for code, w in zip(codes, weights.tolist()):
                    row = rows.setdefault(code, {})
                    row[i] = row.get(i, 0.0) + w / k
        self.row_of = np.zeros(self.base**3, np.int32)
        self.features = np.zeros((len(rows) + 1, len(units)), np.float32)
        for n, (code, row) in enumerate(rows.items(), 1):
            self.row_of[code] = n
            for i, w in row.items():
                self.features[n, i] = w

    def _codes(self, letters: np.ndarray, places: np.ndarray) -> np.ndarray:
        ids = self.letter[letters].astype(np.int64)
        # a subsequence with a letter 0 has a code that no landmark's has
        return (ids[:, places[:, 0]] * self.base + ids[:, places[:, 1]]) * self.base + ids[:, places[:, 2]]

    def kernels(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in units, the powered kernel of each with each landmark), some units at a time;
        units that share nothing with any landmark are left out."""
        for which, letters in _letters(units):
            places, weights = _shape(letters.shape[1])
            step = max(1, TERMS // len(places))
            for a in range(0, len(which), step):
                part = letters[a : a + step]
                ids = self.row_of[self._codes(part, places)]
                rows, columns = np.nonzero(ids)
                if not len(rows):
                    continue
                at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                sums = np.add.reduceat(self.features[ids[rows, columns]] * weights[columns, None], at)
                rows = rows[at]
                own = np.sqrt(_self(part[rows], places, weights)).astype(np.float32)
                yield which[a : a + step][rows], (sums / own[:, None]) ** POWER

    def kernel(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.units)), np.float32)
        for which, k in self.kernels(units):
            out[which] = k
        return out


_marks: dict[str, Landmarks] = {}
_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Model:
    """What a fit finds: the landmarks, a weight for each, and how a text's sum becomes a score."""

    def __init__(self, units: list[str], beta: np.ndarray, bias: float, exponent: float, slope: float, offset: float):
        self.units, self.beta, self.bias = units, beta.astype(np.float32), bias
        self.exponent, self.slope, self.offset = exponent, slope, offset
        self.name = hashlib.sha256(pickle.dumps((units, self.beta.tobytes(), bias, exponent, slope, offset))).hexdigest()

    def word_values(self, tokens: list[str]) -> np.ndarray:
        """The number of each token; of a long word's pieces, the one that says most speaks for it."""
        if self.name not in _marks:
            _marks.clear()
            _marks[self.name] = Landmarks(self.units)
        units = [unit_of(t) for t in tokens]
        parts = [p for u in units for p in pieces(u)] if any(len(u) > LONGEST for u in units) else units
        value = np.zeros(len(parts), np.float32)
        for which, k in _marks[self.name].kernels(parts):
            value[which] = k @ self.beta
        if parts is units:
            return value
        out, at = np.zeros(len(units), np.float32), 0
        for i, u in enumerate(units):
            own = value[at : at + len(pieces(u))]
            out[i], at = own[np.abs(own).argmax()], at + len(own)
        return out

    def _values(self, h: np.ndarray, token: Callable[[int], str]) -> np.ndarray:
        """The number of each token of a slice; a worker remembers those of distinct words."""
        distinct, place, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys, values = _known.get(self.name, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        there = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
        own = np.zeros(len(distinct), np.float32)
        own[there] = values[at[there]]
        if not there.all():
            own[~there] = self.word_values([token(i) for i in place[~there].tolist()])
            if len(keys) + len(distinct) > REMEMBER:
                keys, values = keys[:0], values[:0]
            keys, values = np.concatenate([keys, distinct[~there]]), np.concatenate([values, own[~there]])
            order = np.argsort(keys)
            _known.clear()
            _known[self.name] = keys[order], values[order]
        return own[inverse]

    def scores(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out = [np.zeros(0)]
        for n, h, owner, token in text_tokens(texts):
            sums = np.bincount(owner, self._values(h, token), n)
            margins = sums / (np.bincount(owner, minlength=n) + 1.0) ** self.exponent + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30))))
        return np.concatenate(out)


def choose_landmarks(bags: list[tuple[np.ndarray, np.ndarray]], words: list[str], labels: np.ndarray, n: int) -> list[str]:
    """Three quarters the words that set the labelled texts apart most (by the signed score of
    the shares of texts that hold them), one quarter the most frequent of the other side."""
    held = np.zeros((2, len(words)))
    for (ids, _), y in zip(bags, labels):
        held[y, ids] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    share = held.sum(0) / (n1 + n0)
    apart = (held[1] / n1 - held[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    able = np.array([3 <= len(w) <= LONGEST for w in words])
    first = lambda order, m: [words[i] for i in order[:m]]
    toxic = [i for i in np.lexsort((words, -apart)) if able[i] and held[1, i]]
    clean = [i for i in np.lexsort((words, -held[0])) if able[i] and apart[i] < 0]
    chosen = first(toxic, n * 3 // 4)
    return list(dict.fromkeys(chosen + first(clean, n - len(chosen))))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear support vector machine (L1 loss, balanced classes) by dual coordinate descent."""
    sign = np.where(y == 1, 1.0, -1.0)
    x = np.hstack([x, np.ones((len(x), 1))])
    bound = np.where(y == 1, c * len(y) / (2 * max(1, y.sum())), c * len(y) / (2 * max(1, (1 - y).sum())))
    norms = (x * x).sum(1)
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ w) - 1) / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid, by Newton steps."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, theta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
    return max(float(theta[0]), 1e-3), float(theta[1])


class Bags:
    """Texts as counts of distinct units, gathered batch by batch; of a text no more is kept."""

    def __init__(self):
        self.units: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.sizes: list[int] = []

    def add(self, texts: pa.Array) -> None:
        for n, h, owner, token in text_tokens(texts):
            distinct, place, inverse = np.unique(h, return_index=True, return_inverse=True)
            ids = [[self.units.setdefault(p, len(self.units)) for p in pieces(u)] if (u := unit_of(token(i))) else [] for i in place.tolist()]
            bounds = np.searchsorted(owner, np.arange(n + 1)) if (owner[1:] >= owner[:-1]).all() else None
            order = np.arange(len(owner)) if bounds is not None else np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(n + 1)) if bounds is None else bounds
            for i in range(n):
                own = [u for j in inverse[order[bounds[i] : bounds[i + 1]]].tolist() for u in ids[j]]
                self.rows.append(np.unique(np.array(own, np.int64), return_counts=True))
                self.sizes.append(int(bounds[i + 1] - bounds[i]) + 1)


def fit(texts: list[str | None], labels: list[int], **options) -> Model | None:
    """The model of labelled texts; None if they are not of two kinds."""
    bags = Bags()
    bags.add(pa.array(texts, pa.string()))
    return fit_bags(bags, labels, **options)


def fit_bags(bags: Bags, labels: list[int], landmarks: int = LANDMARKS, exponent: float = 0.5, c: float = 30.0) -> Model | None:
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    words, sizes = list(bags.units), np.array(bags.sizes, float)
    chosen = choose_landmarks(bags.rows, words, y, landmarks)
    marks = Landmarks(chosen)
    sums = np.zeros((len(y), len(chosen)))
    for a in range(0, len(words), 20_000):  # the kernels of some words at a time
        kernels = marks.kernel(words[a : a + 20_000])
        for i, (ids, counts) in enumerate(bags.rows):
            x, z = np.searchsorted(ids, (a, a + 20_000))
            if z > x:
                sums[i] += counts[x:z] @ kernels[ids[x:z] - a]
    own, vectors = np.linalg.eigh(marks.kernel(chosen).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(own, 1e-2))) @ vectors.T
    x = sums / sizes[:, None] ** exponent @ root
    w, b = svm(x, y, c)
    slope, offset = sigmoid_fit(x @ w + b, y)
    return Model(chosen, root @ w, b, exponent, slope, offset)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, use: Column | None = None) -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows, chosen by a hash of the id.

    ``use`` tells by the id which rows may teach. Rows labelled more than once count with
    their largest label, and of an id with several texts the least text teaches; null labels and ids teach nothing.
    """
    one = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg((F.max(label) > 0).cast("int").alias("__y"))
    one = one if use is None else one.where(use)
    there = one.join(docs.select(id_col).distinct(), id_col, "left_semi")
    # at most ``sample`` rows of an id and a label: bounded, so they may be broadcast
    chosen = there.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(F.broadcast(chosen.withColumnRenamed(id_col, "__id")), "__id").groupBy("__id").agg(F.min("__text").alias("text"), F.min("__y").alias("y"))
    return rows.select("text", "y")


def train(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    """The model of the labelled rows, fitted in one task of a bounded number of rows; the driver gets the model only."""
    rows = labelled(docs, labels, **options)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y = Bags(), []
        for batch in batches:
            bags.add(batch.column(0))
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_bags(bags, y))], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "y").mapInArrow(fitted, "model binary")
    found = [pickle.loads(r["model"]) for r in one.collect()]
    return found[0] if found else None


def with_scores(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: how likely the label 1 is, from 0 to 1.

    Only the text is read. A null or empty text scores as a text of no words; texts of any length are read in
    whole. Without a model (no labels, or of one kind) every score is 0. Repeated rows come back repeated; an empty
    table gives an empty table. A column that is called ``name`` already comes back as doc_<name>.
    """
    if name in docs.columns:
        docs = docs.withColumnRenamed(name, f"doc_{name}")
        text = f"doc_{name}" if text == name else text
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    place = docs.columns.index(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array(model.scores(batch.column(place)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(batches, ", ".join([*fields, f"`{name}` double"]))
