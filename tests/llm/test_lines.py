import random

import numpy as np
import pyarrow.parquet as pq

from framelake.llm import lines as L
from framelake.llm.queries import QUERIES
from tests.llm.test_simhash import roots


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        if not t:
            break
        i = rng.randrange(len(t))
        rng.choice([lambda: t.pop(i), lambda: t.insert(i, rng.choice("abé")), lambda: t.__setitem__(i, rng.choice("abé"))])()
    return "".join(t)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))
        b = edited(rng, a, rng.randrange(5)) if a and rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))
        for k in (0, 1, 2, 3):
            assert L.edit_distance(a, b, k) == min(distance(a, b), k + 1), (a, b, k)


def test_keys_meet_within_the_threshold():
    rng = random.Random(2)
    for k in (1, 2):
        for _ in range(300):
            a = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(L.NEAR_FROM + 2, 60)))
            b = edited(rng, a, k)
            if min(len(a), len(b)) < L.NEAR_FROM or a == b:
                continue
            (ka, _, fa), (kb, _, fb) = (L.segment_keys(L.Lines([x]), k) for x in (a, b))
            assert set(ka[fa == 1]) & set(kb[fb == 0]) or set(kb[fb == 1]) & set(ka[fa == 0])
            if k == 1:
                x, y = ({(key, kind) for key, _, kind in zip(*L.without_one(L.Lines([t])))} for t in (a, b))
                of = lambda z, kind: {key for key, k in z if k == kind}
                assert of(x, 1) & of(y, 1) or of(x, 2) & of(y, 0) or of(x, 0) & of(y, 2)


def brute(docs, k=1):
    """(removed line numbers) by id."""
    lines = [(d, i, x) for d, t in sorted(docs.items()) for i, x in enumerate((t or "").split("\n")) if t is not None and len(x) >= L.EXACT_FROM]
    distinct = sorted({x for _, _, x in lines})
    near = [x for x in distinct if len(x) >= L.NEAR_FROM]
    pairs = [(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if abs(len(a) - len(b)) <= k and L.edit_distance(a, b, k) <= k]
    root, seen, out = roots(distinct, pairs), set(), {d: [] for d in docs}
    for d, i, x in lines:
        if root[x] in seen:
            out[d].append(i)
        seen.add(root[x])
    return out


def family(rng):
    base = "This common template line holds one number, which is 00, and ends here."
    return [base.replace("00", f"{i:02d}") for i in range(100)] + [edited(rng, base, 1) for _ in range(60)] + [base[:30] + f" has another end {i * 7919}" for i in range(40)]


def test_common_segments_are_joined_whole(spark, monkeypatch):
    rng = random.Random(3)
    texts = family(rng) + ["short", "exactly ten", "exactly ten", ""]
    docs = {i: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    want = brute(docs)
    for most in (4096, 3):
        monkeypatch.setattr(L, "MOST_PAIRS", most)
        got = {r["doc_id"]: r["removed"] for r in L.line_report(df).collect()}
        assert got == {i: ",".join(map(str, x)) for i, x in want.items()}


def test_rows(spark):
    one, two = "A line that is long enough to count.", "A line that is long enough to count!"
    rows = [(1, f"{one}\nx\nx\n{one}", 5, "q"), (2, None, None, "q"), (3, f"{two}\n\nother words here", 7, "q"), (3, f"{two}\n\nother words here", 7, "q"), (None, one, 1, "q"), (4, "", 0, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, removed string")
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in L.dedup_lines(df).collect()}
    # a null id stands first
    assert got == {(None, one, 1), (1, "x\nx", 3), (2, None, None), (3, "\nother words here", 17), (4, "", 0)}
    assert L.dedup_lines(df).columns == df.columns and L.dedup_lines(df).count() == 6
    assert L.line_report(df.limit(0)).count() == 0 == L.dedup_lines(df.limit(0)).count()
    report = {r["doc_id"]: tuple(r)[1:] for r in L.line_report(df).collect()}
    assert report[1] == (4, 2, 0, "0,3") and report[3] == (3, 1, 1, "0") and report[2] == (0, 0, 0, "")


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: r["removed"] for r in QUERIES["op8_line_dedup"](spark, sf).collect()}
    assert got == {i: ",".join(map(str, x)) for i, x in brute(docs).items()} and np.any([x for x in got.values()])


def test_larger_thresholds(spark, monkeypatch):
    """Two and three edits, with common keys met in blocks of several sizes."""
    rng = random.Random(8)
    texts = family(rng)[::2] + [edited(rng, t, n) for t in family(rng)[:30] for n in (2, 3)] + ["short line"]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for k, most, block in ((2, 4096, 256), (2, 3, 16), (3, 3, 256)):
        monkeypatch.setattr(L, "MOST_PAIRS", most)
        monkeypatch.setattr(L, "BLOCK", block)
        got = {r["doc_id"]: r["removed"] for r in L.line_report(df, k=k).collect()}
        assert got == {i: ",".join(map(str, x)) for i, x in brute(docs, k).items()}, (k, most)
