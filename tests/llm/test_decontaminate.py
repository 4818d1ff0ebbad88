import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from framelake.llm import decontaminate as D
from framelake.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        assert D.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute(a, b)


ITEM = "Which of these seven northern rivers carries more water in spring than all of its neighbours together?"


def test_edited_copies_are_found_and_clean_texts_left(spark):
    filler = " ".join(f"word{i} of the and" for i in range(300))
    edited = "which of those seven northern streams carries more water, in spring than all its neighbours taken together"
    rows = [(1, filler + " " + ITEM.upper() + " " + filler), (2, edited), (3, filler), (4, None), (5, ""), (6, ITEM), (6, ITEM), (None, ITEM), (8, "of these")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, item_id string, score string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, " ?"), (10, "of these")], "item_id long, text string")
    got = {(r[0], r[1]): r[2] for r in D.contaminated(docs, items).collect()}
    assert {k[0] for k in got if k[1] == 7} == {1, 2, 6, None} and {k[0] for k in got if k[1] == 10} == {1, 6, 8, None}
    assert got[1, 7] == got[6, 7] == 1.0 and 0.5 <= got[2, 7] < 1
    small = {(r[0], r[1]): r[2] for r in D.contaminated(docs, items, block=5).collect()}
    assert small == got
    kept = D.clean(docs, items.where("item_id = 7"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 8]
    # the text decides, not the id
    shared = spark.createDataFrame([(1, ITEM), (1, filler), (None, filler), (None, ITEM), (1, filler)], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in D.clean(shared, items).orderBy("doc_id").collect()] == [(None, filler), (1, filler), (1, filler)]
    assert D.contaminated(docs.limit(0), items).count() == 0 == D.contaminated(docs, items.limit(0)).count()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], tokens(r["text"])) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    want = {}
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        words = tokens(d["text"])
        held = {w for w in zip(words, words[1:], words[2:])}
        for item, w in items:
            if sum(g in held for g in zip(w, w[1:], w[2:])) and (score := brute(w, words) / (2 * len(w))) >= D.LEAST_SCORE:
                want[d["doc_id"], item] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in QUERIES["op5_decontamination"](spark, sf).collect()}
    assert want and got == pytest.approx(want)
