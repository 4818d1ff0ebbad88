import random

import pyarrow.parquet as pq
import xxhash

from framelake.llm.components import connected_components
from framelake.llm.queries import QUERIES
from framelake.llm.shared import written
from framelake.llm.simhash import _linked, _probed, fingerprint, fingerprint_links, near_fingerprints, segments_for, simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string, component_id string, fp string"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_hand():
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in ("a b c", "b c a", "c a b", "a b c")]
    want = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) > 2)
    assert fingerprint(" A b\tC\x0ba b c ") == want
    assert fingerprint("Two words") == xxhash.xxh64_intdigest("two words", seed=42)
    assert fingerprint("Ä b c") == xxhash.xxh64_intdigest("Ä b c", seed=42)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_links_connect_what_brute_force_links(spark):
    rng = random.Random(3)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(25):  # dense groups, so that table rows of every size occur
            base_ = base
            for _ in range(rng.randrange(5)):
                base_ ^= 1 << rng.randrange(64)
            values.add(base_)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = connected_components(fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    found = {r["node"]: r["component"] for r in got.collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    want = roots(signed, pairs)
    assert {v: found.get(v, v) for v in signed} == want


def test_groups_edge_cases(spark):
    rows = [(5, None, "x", "y"), (3, "", "x", "y"), (3, "", "x", "y"), (7, "one two three four", None, None), (8, "ONE two  three four", "", ""), (None, "other words stand here", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash_groups(df).collect())
    assert got == [(-1, None), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7)]
    assert sorted(r["doc_id"] or -1 for r in simhash_dedup(df).collect()) == [-1, 3, 7]
    # rows, not ids: five texts of which ids repeat or are missing
    texts = ["a b c d", "e f g h", "i j k l", "m n o p", "q r s t"]
    own = spark.createDataFrame(list(zip((None, None, 5, 5, 5), texts)) + [(5, "q r s t"), (6, "q r s t")], "doc_id long, text string")
    kept = simhash_dedup(own).collect()
    assert sorted(r["text"] for r in kept) == texts and {r["doc_id"] for r in kept if r["text"] == texts[4]} == {5}
    assert simhash_groups(df.limit(0)).count() == 0 == simhash_dedup(df.limit(0)).count()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, sf).collect()}
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    fps = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = roots(fps, pairs)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


def test_no_table_that_grows_goes_through_the_driver(spark, monkeypatch):
    """Where all sizes are taken to be small: an explode is taken to be as large as what goes in."""
    plans = []

    def ran(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    rng = random.Random(5)
    bases = [rng.getrandbits(63) for _ in range(300)]
    fps = {b ^ 1 << rng.randrange(63) for b in bases for _ in range(4)}
    monkeypatch.setattr("framelake.llm.simhash.written", ran)
    links = fingerprint_links(spark.createDataFrame([(v,) for v in fps], "fp long"))
    ran(links, "links")
    docs = spark.createDataFrame([(i, f"a text of word{i % 50} and its own end") for i in range(200)], "doc_id long, text string")
    ran(simhash_groups(docs), "groups")
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_near_fingerprints_against_brute_force(spark):
    rng = random.Random(9)
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << i for i in rng.sample(range(64), k % 10)) for k, v in enumerate(values)]
    family = {values[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values[1:60] + values[61:])]
    alone = spark.createDataFrame([(v,) for v in signed], "fp long")
    assert [segments_for(n) for n in (0, 100, 8191, 8192, 235_000, 15_000_000, 1 << 40)] == [4, 4, 4, 3, 3, 2, 2]
    for segments in (2, 3, 4):
        got = {(max(r), min(r)) for r in near_fingerprints(alone, segments).collect()}
        assert got == {(a, b) for a in signed for b in signed if a > b and bits(a, b) < 2 * segments}
        # rows of many members: what connects them, not all pairs
        many = [v - (1 << 64) if v >> 63 else v for v in family]
        got = [tuple(r) for r in near_fingerprints(spark.createDataFrame([(v,) for v in many], "fp long"), segments).collect()]
        assert all(bits(*r) < 2 * segments for r in got) and len(set(roots(many, got).values())) == 1


def test_unrelated_fingerprints_do_not_meet(spark, monkeypatch):
    """What the tables return doesn't grow with the square of the table, and pairs at the full reach are found."""
    made = []

    def counted(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr("framelake.llm.simhash.written", counted)
    rng = random.Random(11)
    values = [rng.getrandbits(64) for _ in range(20_000)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    # 5 bits, of which 0 to 5 in the lower half
    near = [v ^ sum(1 << i for i in rng.sample(range(32), k % 6) + rng.sample(range(32, 64), 5 - k % 6)) for k, v in enumerate(values[:60])]
    signed += [v - (1 << 64) if v >> 63 else v for v in near]
    assert segments_for(len(signed)) == 3
    got = {frozenset(r) for r in near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 3).collect()}
    assert got == {frozenset((signed[k], signed[20_000 + k])) for k in range(60)}
    assert sum(n for name, n in made if name == "probes") < 3000


def test_families_keep_what_three_segments_find(spark):
    """Larger rows of the tables of halves hide no pair that a table of three segments gives."""
    rng = random.Random(13)
    values = set()
    for _ in range(200):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for _ in range(4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {frozenset(r) for r in _linked(_probed(fps, 3), 5).collect()}
    got = {frozenset(r) for r in near_fingerprints(fps, 3).collect()}
    assert len(want) > 300 and want <= got
