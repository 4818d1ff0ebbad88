"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves. Each half has a codebook, fitted on a bounded sample; a
pair of codes is a cell of the product grid, under which every vector is filed. A vector
visits cells in the order of their summed distances, by the multi-sequence method, until
the share of true neighbours that a calibration on the sample asks for lies behind it. What the visited cells
hold is verified in double precision. The codebooks grow with the root of the table, so a cell doesn't.

A dense group of near vectors has links in the square of its size, so links are not listed: each block of a cell
and of its visitors gives, for each of its vectors, how many it links with, and one vector that stands for all
that its links reach in the block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.shared import written

LEAST_COSINE = 0.9
#: Vectors that the codebooks are fitted on, at most (and no fewer than EACH of a code); the stopping point is fitted on SAMPLE of them.
SAMPLE, EACH = 8192, 16
#: Vectors that a cell would hold if all held as many; codes of a codebook, at least and at most.
CELL, LEAST_CODES, MOST_CODES = 64, 16, 4096
#: Neighbouring cells of one row of the grid that are looked up together, so that a vector travels once for them.
TOGETHER = 16
TARGET_RECALL = 0.995
#: Pairs of each sample vector that the stopping point is judged by, at most.
PAIRS_EACH = 8
#: Vectors of a cell that one block of the verification holds.
BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def codes_for(vectors: int) -> int:
    """Codes of each half's codebook for a table of so many vectors."""
    return min(max(int(np.ceil(np.sqrt(vectors / CELL))), LEAST_CODES), MOST_CODES)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means centres; fewer where there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        code = np.concatenate([nearest(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(code, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells (i, j) in rising order of a[i] + b[j], up to the sum ``most``; at least one.

    A heap holds the front: a cell enters it when the one before it in both directions was visited.
    """
    order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    front, seen, out = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}, []
    while front:
        d, i, j = heapq.heappop(front)
        if out and d > most:
            break
        out.append((order_a[i], order_b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(front, (a[order_a[x]] + b[order_b[y]], x, y))
    return out


class Index:
    """Codebooks of two halves and, by calibration, how far past its own cell a vector looks."""

    def __init__(self, sample: np.ndarray, codes: int | None = None, least: float = LEAST_COSINE, recall: float = TARGET_RECALL):
        x = unit(sample)
        self.half = max(1, x.shape[1] // 2)
        parts = [x[:, : self.half], x[:, self.half :] if x.shape[1] > 1 else np.zeros((len(x), 1))]
        self.books = [codebook(p, codes or codes_for(len(x))) for p in parts]
        # neighbours in the second half stand near each other
        centred = self.books[1] - self.books[1].mean(0)
        self.books[1] = self.books[1][np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
        self.reach = self._calibrate(x[:SAMPLE], least, recall)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = x[:, self.half :] if x.shape[1] > 1 else np.zeros((len(x), 1))
        return nearest(x[:, : self.half], self.books[0]), nearest(right, self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _calibrate(self, x: np.ndarray, least: float, recall: float) -> float:
        """How much more distant than its nearest cell a cell may be: what the wanted share of
        the sample's own neighbour pairs needs, weighed by vector and by cell, and that of pairs drawn
        around sample vectors, from the threshold to 1 and at the threshold, each judged apart. The
        largest holds, so no group of near vectors sets it alone."""
        rng = np.random.default_rng(3)
        base = x[rng.choice(len(x), min(len(x), 2048), replace=False)]
        noise = rng.standard_normal(base.shape)
        noise -= (noise * base).sum(1, keepdims=True) * base
        noise = unit(noise) if x.shape[1] > 1 else np.zeros_like(base)
        cosine = least + (1 - least) * rng.random((len(base), 1))
        drawn = self._more(base, cosine * base + np.sqrt(1 - cosine**2) * noise)
        edge = self._more(base, least * base + np.sqrt(1 - least**2) * noise)
        left, right = [], []
        for i in range(0, len(x), 1024):
            near = x[i : i + 1024] @ x.T >= least
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            # a few pairs of each vector, so that a group of near vectors weighs as its vectors do
            order = np.where(near, rng.random(near.shape, dtype=np.float32), 2)
            few = np.argpartition(order, min(PAIRS_EACH, len(x) - 1), axis=1)[:, :PAIRS_EACH]
            p, q = np.nonzero(np.take_along_axis(near, few, 1))
            left.append(p + i)
            right.append(few[p, q])
        left, right = np.concatenate(left), np.concatenate(right)
        own = self._more(x[left], x[right])
        # and by cell: the pairs of a crowded cell are not more than those of any other
        cell = self.cells(x)[left]
        order = np.argsort(own, kind="stable")
        share = np.cumsum((1 / np.bincount(cell, minlength=1)[cell])[order]) if len(own) else own
        by_cell = own[order][min(np.searchsorted(share, recall * share[-1]), len(own) - 1)] if len(own) else 0
        found = [float(np.quantile(m, recall)) for m in (drawn, edge, own) if len(m)]
        return max([*found, float(by_cell)]) + 1e-12

    def _more(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How much more distant than its nearest cell the cell of ``right`` is, for each of ``left``."""
        a, b = self.distances(left)
        cell = self.cells(right)
        return a[np.arange(len(a)), cell // len(self.books[1])] + b[np.arange(len(b)), cell % len(self.books[1])] - a.min(1) - b.min(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.distances(x)
        n = len(self.books[1])
        return [[i * n + j for i, j in multi_sequence(p, q, p.min() + q.min() + self.reach)] for p, q in zip(a, b)]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector is neither null, empty nor zero and holds finite numbers only; floats stay floats,
    other numbers become doubles."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector), lambda x: x.cast(kind))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def linked_in(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a table of links the least id that links reach in it."""
    rows, columns, far = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        before = rows.sum(), columns.sum()
        for i in range(0, len(rows), 512):
            part = near[i : i + 512]
            rows[i : i + 512] = np.minimum(rows[i : i + 512], np.where(part, columns, far).min(1, initial=far))
            columns = np.minimum(columns, np.where(part, rows[i : i + 512, None], far).min(0, initial=far))
        if (rows.sum(), columns.sum()) == before:
            return rows, columns


def cosine_links(reps: DataFrame, least: float = LEAST_COSINE, codes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(a, b, others) for distinct vectors (rep, v, n: how many rows have it) of one dimension: rows of a that has
    links of cosine ``least`` or more in some block. ``others`` sums up to the rows that a links with,
    and the pairs (a, b) connect what links connect.

    The index is fitted on ``sample`` vectors and files every one. A cell's vectors are dealt to
    blocks of about BLOCK rows, and every visitor meets every block of a cell, in blocks
    as well, so a cell that holds a third of all vectors is many tasks' work. Two vectors meet once in each direction in
    which one visits the cell of the other; the second time doesn't count.
    """
    codes = codes or codes_for(reps.count())
    rows = reps.orderBy(F.xxhash64("rep")).limit(max(sample, EACH * codes)).select("v").collect()
    if len(rows) < 2:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("long").alias("others")).limit(0)
    index = Index(np.array([r["v"] for r in rows], np.float64), codes, least)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = unit(_vectors(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(index.cells(x), pa.int32()), pa.array(index.visits(x), pa.list_(pa.int32()))], names=["rep", "v", "n", "cell", "visits"])

    kind = reps.schema["v"].dataType.simpleString()
    filed = written(reps.select("rep", "v", "n").mapInArrow(file, f"rep long, v {kind}, n long, cell int, visits array<int>"), "cells")
    width = len(index.books[1])
    bin_of = lambda c: (F.floor(c / width) * (width // TOGETHER + 1) + F.floor(c % width / TOGETHER)).cast("int")
    bins = F.array_distinct(F.transform("visits", bin_of))
    looks = F.explode(F.transform(bins, lambda b: F.struct(b.alias("bin"), F.filter("visits", lambda c: bin_of(c) == b).alias("cells"))))
    looks = filed.select("rep", "v", "n", F.col("cell").alias("home"), looks.alias("look")).select("look.bin", "look.cells", "rep", "v", "n", "home", F.lit(False).alias("filed"))
    held = filed.select(bin_of(F.col("cell")).alias("bin"), F.col("visits").alias("cells"), "rep", "v", "n", F.col("cell").alias("home"), F.lit(True).alias("filed"))
    # a row per bin that holds any vector: how many blocks its vectors are dealt to, and parts its visitors
    sizes = held.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    many = filed.select(F.explode(bins).alias("bin")).groupBy("bin").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("parts"))
    sizes = sizes.join(many, "bin")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    looks = looks.join(sizes, "bin").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")).withColumn("block", every("blocks"))
    held = held.join(sizes, "bin").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        filed = group.column("filed").to_numpy()
        ids, n, home = (np.array(group.column(c).to_numpy(), np.int64) for c in ("rep", "n", "home"))
        x = unit(_vectors(group.column("v").combine_chunks()))
        cells = group.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False))
        flat = np.asarray(cells.flatten().to_numpy(zero_copy_only=False))
        looks = ~filed[owner]
        order = np.argsort(flat[looks], kind="stable")
        wanted, visitor = flat[looks][order], owner[looks][order]
        # which filed vectors visit which homes of visitors: such a pair meets the other way round as well
        homes, of_home = np.unique(home, return_inverse=True)
        place = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
        meets = np.zeros((len(homes), len(ids)), bool)
        known = (homes[place] == flat) & ~looks
        meets[place[known], owner[known]] = True
        out = [np.zeros((3, 0), np.int64)]
        for cell in np.unique(home[filed]):
            f = np.flatnonzero(filed & (home == cell))
            v = visitor[np.searchsorted(wanted, cell) : np.searchsorted(wanted, cell, "right")]
            near = x[v] @ x[f].T >= least
            near &= ids[v][:, None] != ids[f]
            rows, columns = near.any(1), near.any(0)
            if rows.any():
                near, v, f = near[rows][:, columns], v[rows], f[columns]
                once = np.concatenate([n[v[i : i + 512]] @ (near[i : i + 512] & ~meets[of_home[v[i : i + 512]]][:, f]) for i in range(0, len(v), 512)]).reshape(-1, len(f)).sum(0)
                left, right = linked_in(near, ids[v], ids[f])
                out.append(np.concatenate([[ids[v], left, near @ n[f]], [ids[f], right, once]], axis=1))
        a, b, others = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "others": pa.array(others, pa.int64())})

    met = held.unionByName(looks).select("bin", "block", "part", "cells", "rep", "v", "n", "home", "filed")
    return met.groupBy("bin", "block", "part").applyInArrow(verify, "a long, b long, others long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, codes: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_links (other rows linked to it), component_id (smallest id
    reachable), kept (the id is that smallest).

    Equal vectors are one for the search, and count one by one. Vectors of other dimensions than most (the
    commonest) are compared among their like. Rows with a null, empty or zero vector, or one with null
    or non-finite numbers, and rows without an id, link with nothing. Repeated rows link with each other.
    """
    rows = valid_vectors(df, id_col, vector).where("id is not null")
    groups = written(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    found = None
    for d in sorted(r[0] for r in groups.select(F.size("v")).distinct().collect()):
        part = cosine_links(groups.where(F.size("v") == d), least, codes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("long").alias("others")).limit(0)
    found = written(found, "cosines")
    others = found.groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    classes = connected_components(found, "a", "b")
    found = groups.join(others, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.select("id", "v").join(found, "v").select(F.col("id").alias("__id"), "n_links", "component_id").distinct()
    # an id whose rows hold several vectors has their least component and all their links
    linked = linked.groupBy("__id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    alone = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(F.col(vector), lambda x: x != 0)
    out = df.select(F.col(id_col).alias("__own"), F.coalesce(alone, F.lit(False)).alias("__fine"))
    out = out.join(linked, (out["__own"] == linked["__id"]) & out["__fine"], "left")
    component = F.coalesce("component_id", "__own")
    return out.select(F.col("__own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("__own")).alias("kept"))
