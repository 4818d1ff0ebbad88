import zlib
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from framelake.llm import toxicity as T
from framelake.llm.queries import QUERIES


def brute_kernel(a, b):
    def features(u):
        out = {}
        places = [c for c in combinations(range(len(u)), 3) if c[2] - c[0] <= 2 + T.GAPS]
        for c in places:
            key = "".join(u[i] for i in c)
            out[key] = out.get(key, 0) + T.DECAY ** (c[2] - c[0] - 2)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(p[k] * q.get(k, 0) for k in p)
    k = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
    return k**T.POWER


def test_kernel_is_the_definition():
    marks = ["idiot", "réeuxment", "worthless", "banana", "глупец"]
    units = ["глупей", "другой", "idiot", "idxiot", "idioot", "worthles", "réeuxtre", "banana", "nanaba", "plain", "an", "x"]
    got = T.Landmarks(marks).kernel(units)
    for i, u in enumerate(units):
        for j, m in enumerate(marks):
            if len(u) >= 3:
                assert got[i, j] == pytest.approx(brute_kernel(u, m), abs=1e-4), (u, m)
    assert got[2, 0] == pytest.approx(1, abs=1e-4) and got[3, 0] > 0.02 and got[0, 4] > 0.02 > 100 * got[1, 4]


def test_gapped_and_inserted_insults_are_found():
    rng = np.random.default_rng(1)
    plain = ["the", "river", "table", "green", "walk", "sun", "house", "paper", "and", "of"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 20))
        if i % 4 == 0:
            words[3] = rng.choice(["idiot", "moron", "worthless"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = T.fit(texts, labels)
    clean, *bad = model.scores(["the sun and the green river of the paper house walk"] + [f"the sun and {w} green river of the paper house walk" for w in ("idiot", "id-io-t", "i d i o t", "worth.less", "mooron")])
    assert clean < 0.3 and min(bad) >= 0.3
    # a letter inside lessens a match, and more of such words make up for it
    once, often = model.scores(["the sun and idixot green river of the paper house walk", "the idixot and worthxless green idixot of the moroxn house idixot"])
    assert once > 3 * clean and often >= 0.3
    assert 0 <= model.scores([None])[0] < 0.3 and model.scores([""]) == model.scores([None])
    assert T.fit(["a"], [1]) is None


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "you idiot", "y")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    assert model is None and [tuple(r) for r in T.labelled(docs, labels).collect()] == [(None, 1)]
    assert [r["score"] for r in T.with_scores(docs, model).collect()] == [0.0] * 3
    model = T.fit(["you idiot", "hello there"] * 3, [1, 0] * 3)
    got = T.with_scores(docs, model)
    assert T.with_scores(docs.withColumnRenamed("toxic", "score"), model).columns == ["doc_id", "text", "doc_score", "score"]
    assert got.columns == ["doc_id", "text", "toxic", "score"] and got.count() == 3 and T.with_scores(docs.limit(0), model).count() == 0


def test_scores_are_the_definition(spark):
    """The query's scores by plain loops over words; long words, runs of single letters, a very long text."""
    rng = np.random.default_rng(2)
    words = ["idiot", "river", "moron", "table", "Sun", "a" * 40 + "idiot", "x-y", "Ünder", "глупец", "12"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 40)] + [None, "i d i o t walks", "a b", "idiot " * 50_000]
    model = T.fit(["you idiot", "hello river", "moron here", "table Sun"] * 5, [1, 0, 1, 0] * 5)

    def value(token):
        found = [sum(float(b) * brute_kernel(p, m) for b, m in zip(model.beta, model.units)) for p in T.pieces(T.unit_of(token)) if len(p) > 2]
        return max(found, key=abs, default=0.0)

    for text, got in zip(texts, model.scores(texts)):
        tokens = (text or "").split()
        joined = ["idiot"] if text == "i d i o t walks" else []
        known = {t: value(t) for t in set(tokens + joined)}
        margin = sum(known[t] for t in tokens + joined) / (len(tokens + joined) + 1) ** model.exponent + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30))), abs=2e-3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in T.with_scores(df, model).collect()}
    assert [rows[i] for i in range(len(texts))] == pytest.approx(model.scores(texts).tolist())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in held)
    assert hit / sum(labels[r["doc_id"]] for r in held) > 0.8
    assert hit / sum(r["predicted"] for r in held) > 0.85
