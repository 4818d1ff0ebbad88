from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.llm import mixing, preference
from framelake.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name])


def test_targets_by_hand(spark):
    rows = [("sa", "a", 100), ("sb", "b", 1000), ("sc", "c", 10), ("n", None, 90)]
    got = {r["skey"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()}
    # weights 1, 2, 3, 1 of 1200; c stops at 30, the others share 1170: 292.5, 585, 292.5; null stops at 270, a and b share 900: 300, 600
    assert got == pytest.approx({"sa": 300, "sb": 600, "sc": 30, "n": 270})


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}" if i % 10 else None, "t") for i in range(300)] + [(5, None, "s0", "t"), (5, None, "s0", "t"), (None, "x y", "s1", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = [tuple(r) for r in mixing.mix_sources(df).collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mixing.mix_sources(df.repartition(7)).collect()), key=repr)
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for _, s, size, _, t, n, epochs in got:
        assert epochs * size <= n <= min(3, epochs + 1) * size
        taken[s] += n
        target[s] = t
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5
    assert mixing.mix_sources(df.limit(0)).count() == 0
    kept = mixing.mix_sources(df, keep=("doc_id", "text"))
    assert kept.columns[:3] == ["doc_id", "source", "text"] and kept.count() == len(rows)
    clash = mixing.mix_sources(df, keep=("taken", "text"))
    assert clash.columns == ["doc_id", "source", "doc_taken", "text", *mixing.RESULTS] and clash.first()["doc_taken"] == "t"


def test_quality_raises_the_chance(spark):
    rows = [(i, ("good words here " if i % 2 else "%%% 123 $$$ ") * 3, "one" if i < 1500 else "two") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    drawn = [r["doc_id"] % 2 for r in got if r["source"] == "two" and r["taken"] % max(r["size"], 1) == 0 and r["taken"] > r["epochs"] * r["size"]]
    assert drawn and sum(drawn) / len(drawn) > 0.75


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")


def test_preference_by_hand(spark):
    rows = [
        (1, 0, "user", "hi", ""), (1, 1, "assistant", "A", ""), (1, 2, "user", "more", ""), (1, 3, "assistant", "B", ""),
        (2, 0, "user", "hi", ""), (2, 1, "assistant", "A", ""), (2, 2, "user", "less", ""), (2, 2, "user", "less", ""),
        (3, 0, None, None, ""), (4, 0, "user", "hi", ""), (None, 0, "user", "hi", ""),
    ]
    convs = preference.conversations_as_arrays(turns(spark, rows))
    got = {r["rejected_id"]: r for r in preference.format_preferences(preference.pair_by_first_turn(convs)).collect()}
    assert set(got) == {2, 4, None}
    assert got[2]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nA<|end|>\n" and got[2]["n_prompt_turns"] == 2
    assert got[2]["chosen"] == "<|user|>\nmore<|end|>\n<|assistant|>\nB<|end|>\n"
    start, end = map(int, got[2]["chosen_mask"].split(":"))
    assert got[2]["chosen"][start:end] == "B<|end|>" and got[2]["rejected_mask"] == ""
    assert got[4]["rejected"] == "" and got[4]["n_prompt_turns"] == 1
    assert got[None]["chosen"] == "<|unknown|>\n<|end|>\n" and got[None]["rejected"] is None
    assert preference.format_preferences(preference.pair_by_first_turn(convs.limit(0))).count() == 0
    clash = preference.pair_by_first_turn(convs).withColumn("prompt", F.lit("p"))
    assert {r["pair_prompt"] for r in preference.format_preferences(clash).collect()} == {"p"}
