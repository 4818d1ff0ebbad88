import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from framelake.llm.multiindex import multi_sequence, near_vectors
from framelake.llm.queries import QUERIES
from tests.llm.test_simhash import roots


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    got = multi_sequence(a, b, 1.0)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(6) for j in range(5) if a[i] + b[j] <= 1.0}
    assert len(multi_sequence(a, b, -1)) == 1


def brute(x):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def recall(rows, ids, near):
    want = {i: int(n) for i, n in zip(ids, near.sum(1))}
    assert all(r["n_links"] <= want[r["vec_id"]] for r in rows)
    return sum(r["n_links"] for r in rows) / max(1, sum(want.values()))


def test_query_against_brute_force(spark, tmp_path):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in t], np.float64)
    rng = np.random.default_rng(5)
    # near copies at cosines from 0.85 to 1, of a few vectors many times
    of = np.minimum(rng.geometric(0.02, 700), len(x)) - 1
    noise = rng.standard_normal((700, x.shape[1]))
    noise -= (noise * x[of]).sum(1, keepdims=True) / (x[of] ** 2).sum(1, keepdims=True) * x[of]
    tangent = np.sqrt(1 / rng.uniform(0.85, 1, 700) ** 2 - 1) * np.sqrt((x[of] ** 2).sum(1) / (noise**2).sum(1))
    x = np.concatenate([x, x[of] + noise * tangent[:, None]]).astype(np.float32)
    ids = list(range(len(x)))
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x), "label": [0] * len(x)}), tmp_path / "embeddings.parquet")
    near = brute(x.astype(np.float64))
    rows = QUERIES["op7_embeddings"](spark, str(tmp_path)).collect()
    assert near.sum() > 500 and len(rows) == len(ids) and recall(rows, ids, near) >= 0.97
    root = roots(ids, [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert all(r["component_id"] >= root[r["vec_id"]] and r["kept"] == (r["component_id"] == r["vec_id"]) for r in rows)
    assert recall(rows, ids, near) < 1 or {r["vec_id"]: r["component_id"] for r in rows} == root


def test_dense_groups_and_odd_rows(spark, monkeypatch):
    import framelake.llm.multiindex as M

    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((20, 8))
    x = np.concatenate([base, base[0] + 0.05 * rng.standard_normal((150, 8)), np.repeat(base[1:2], 40, 0), 3 * base[2:3]])
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x)]
    odd = [(1000, None, "q"), (1001, [0.0] * 8, "q"), (1002, [1.0, None] * 4, "q"), (1003, [float("nan")] * 8, "q"), (1004, [float("inf")] * 8, "q"), (1005, [], "q"), (None, [1.0] * 8, "q")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    near = brute(x)
    assert recall([r for k, r in got.items() if k is not None and k < 1000], range(len(x)), near) >= 0.98
    for k in [1000, 1001, 1002, 1003, 1004, 1005, None]:
        assert tuple(got[k]) == (k, 0, k, True)
    assert near_vectors(df.limit(0)).count() == 0 and near_vectors(df.where("vec_id > 999")).count() == 6


def test_pairs_outside_a_hot_group_are_found():
    from framelake.llm.multiindex import Index, unit

    rng = np.random.default_rng(7)
    base = unit(rng.standard_normal((1200, 32)))
    noise = rng.standard_normal(base.shape)
    noise = unit(noise - (noise * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.9, 1, (len(base), 1))
    pairs = c * base + np.sqrt(1 - c**2) * noise
    hot = unit(base[0] + 0.03 * rng.standard_normal((1200, 32)))
    index = Index(np.concatenate([base, pairs, hot]))
    found = [cell in set(seen) for cell, seen in zip(index.cells(pairs).tolist(), index.visits(base))]
    assert np.mean(found) >= 0.97
