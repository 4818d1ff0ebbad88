from collections import defaultdict

import corpus_pipeline
from framelake.llm import decontaminate as D
from framelake.llm.queries import QUERIES
from framelake.llm.shared import written
from tests.llm.test_decontaminate import brute as aligned
from tests.llm.test_decontaminate import tokens
from tests.llm.test_lines import brute as removed
from tests.llm.test_jaccard import brute as apart

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        out.append(docs)
        if name != "mixing":
            assert docs.columns == columns, name
    rows = [{r["doc_id"]: r for r in df.collect()} for df in out]
    bad = {r["doc_id"] for r in QUERIES["op3_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - bad
    lost = removed({i: r["text"] for i, r in rows[1].items()})
    for i, r in rows[1].items():
        left = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in lost[i])
        assert rows[2][i]["text"] == left and (not lost[i] or rows[2][i]["n_chars"] == len(left))
    assert set(rows[3]) == set(apart([(i, r["text"]) for i, r in rows[2].items()]))
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in rows[3].items():
        words = tokens(r["text"])
        held = set(zip(words, words[1:], words[2:]))
        hit = any(any(g in held for g in zip(w, w[1:], w[2:])) and aligned(w, words) / (2 * len(w)) >= D.LEAST_SCORE for w in items)
        assert hit == (i not in rows[4])
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for i, r in rows[5].items():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 < r["taken"] <= 3 * r["size"] and r["text"] == rows[4][i]["text"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.collect()), key=repr) == sorted(map(tuple, out[5].collect()), key=repr)


def test_stages_with_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, clashing columns and empty tables."""
    long = "this line is long enough and stands once " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (1, long + " again", "en", "a", 5), (None, None, None, None, None), (None, "other words stand here alone", "en", None, 1), (2, "", "en", "b", 0), (3, long.upper(), "en", "b", 7)]
    docs = spark.createDataFrame([(*r, i, "x", 0.5, "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, node long, score string, size double, taken string")
    for given in (docs, docs.limit(0)):
        at = given
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, SF), "test")
            if name != "mixing":
                assert at.columns == docs.columns, name
            if name == "toxicity":
                assert at.count() == given.count()
            if name == "line dedup":
                assert at.count() == given.count()
        assert at.count() == 0 if given is not docs else at.count() > 0
