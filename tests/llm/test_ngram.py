import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake.llm.ngram import discounts, pack, score, train, unpack
from framelake.llm.queries import QUERIES
from framelake.llm.tokens import text_slices, words


def tokens_of(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


class Brute:
    def __init__(self, texts):
        self.c, self.big = Counter(), Counter()
        for t in texts:
            toks = tokens_of(t)
            self.c.update(toks)
            self.big.update(zip(["<begin>", *toks], toks))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.cont = Counter(w for _, w in self.big)
        self.follow = defaultdict(list)
        for (v, _), n in self.big.items():
            self.follow[v].append(n)
        of = lambda counts: discounts([sum(x == i for x in counts) for i in (1, 2, 3, 4)])
        self.d2, self.d1 = of(list(self.big.values())), of(list(self.cont.values()))

    def p(self, v, w):
        cut = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)
        left = lambda counts, d: sum(d[min(n, 3) - 1] for n in counts)
        if not self.big:
            return 1.0
        total = len(self.big)
        low = cut(self.cont[w], self.d1) / total + left(self.cont.values(), self.d1) / total / (self.v + 1)
        if v not in self.follow:
            return low
        s = sum(self.follow[v])
        return cut(self.big[v, w], self.d2) / s + left(self.follow[v], self.d2) / s * low

    def score(self, text):
        toks = tokens_of(text)
        base = sum(math.log10((self.c[t] + 0.1) / (self.n + 0.1 * (self.v + 1))) for t in toks)
        full = sum(math.log10(self.p(v, w)) for v, w in zip(["<begin>", *toks], toks))
        return len(toks), sum(self.c[t] > 0 for t in toks), self.n, base, full


def test_words_are_cut_and_hashed_alike():
    texts = ["Ab  cd\nAB", None, "", "é x y", "z" * 70_000 + " ab"]
    seen = {}
    for a, b, data, offsets in text_slices(pa.array(texts).slice(0), 64):
        h, s, e, n = words(data, offsets)
        at = 0
        for i, k in zip(range(a, b), n):
            want = tokens_of(texts[i])[:-1]
            assert k == len(want)
            for w, x in zip(want, h[at : at + k]):
                assert seen.setdefault(w, x) == x
            at += k
    assert len(set(seen.values())) == len(seen) == 5


def test_blobs_come_back():
    arrays = [np.array([1, 5, 1 << 63], np.uint64), np.array([7, 3, 300], np.uint64), np.zeros(0, np.uint64)]
    assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays))))


def test_probabilities_sum_to_one():
    brute = Brute(["a b a b c", "b c d a", "a a a b"])
    for v in ["<begin>", "a", "never"]:
        assert sum(brute.p(v, w) for w in [*brute.c, "unknown"]) == pytest.approx(1)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    brute = Brute(t for i, t in docs.items() if not held[i])
    rows = QUERIES["op1_ngram"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, train_tokens, base, full = brute.score(docs[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, train_tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(full, rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (4, "", "")], "doc_id long, text string, score string")
    brute = Brute([None, None, "a b", ""])
    got = score(df, train(df)).collect()
    want = {None: brute.score("a b"), 1: brute.score(""), 4: brute.score("")}
    for r in got:
        assert list(r[1:]) == pytest.approx(list(want[r["doc_id"]]))
    empty = train(df.limit(0))
    assert [r["score"] for r in score(df, empty).collect()] == [0.0] * 4
    assert score(df.limit(0), empty).count() == 0


class BruteOrder:
    """Any order by recursion: the highest counts occurrences, lower ones distinct words before."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        grams = Counter()
        for t in texts:
            toks = ["<begin>"] * (order - 1) + tokens_of(t)
            grams.update(tuple(toks[i - order + 1 : i + 1]) for i in range(order - 1, len(toks)))
        self.vocabulary = len({g[-1] for g in grams})
        for k in range(order, 0, -1):
            self.counts[k] = grams
            grams = Counter(g[1:] for g in grams)
        self.d = {k: discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in self.counts.items()}
        self.follow = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.follow[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (self.vocabulary + 1)
        rest = self.follow[k].get(gram[:-1])
        if not rest:
            return lower
        n, d = self.counts[k][gram], self.d[k]
        return max(n - (0, *d)[min(n, 3)], 0) / sum(rest) + sum(d[min(m, 3) - 1] for m in rest) / sum(rest) * lower

    def score(self, text):
        toks = ["<begin>"] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.p(tuple(toks[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(toks)))


@pytest.mark.parametrize("order, shard", [(2, 4 << 20), (3, 4 << 20), (3, 500), (4, 2000)])
def test_orders_against_brute_force(spark, monkeypatch, order, shard):
    import framelake.llm.ngram as N

    monkeypatch.setattr(N, "SHARD", shard)
    texts = [d["text"] for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 40).to_pylist()] + [None, "", "a b a b a b a b"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learnt, brute = df.where("doc_id < 30 or doc_id > 41"), BruteOrder([t for i, t in enumerate(texts) if i < 30 or i > 41], order)
    model = train(learnt, order=order)
    assert [x["distinct"] for x in model["levels"]] == [len(brute.counts[k]) for k in range(2, order + 1)]
    got = {r["doc_id"]: r["score"] for r in score(df, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.score(t), rel=1e-9), i
    with pytest.raises(ValueError):
        train(df, order=1)
