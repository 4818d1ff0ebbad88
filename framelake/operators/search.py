"""Motion search and prediction on tables of pictures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.codecs import motion
from framelake.codecs import transform as T
from framelake.functions import exprs as E
from framelake.operators.kernels import added

COST = "array<struct<ord:int,dx:int,dy:int,difference:bigint,bytes:bigint,distortion:bigint>>"


def candidates(reach: Column, x: Column, y: Column, most: int = 32) -> Column:
    """Even displacements (dx, dy) to try within ``reach``: none, a cross around (x, y) and the corners next to none. Of equal
    ones the first is kept."""
    reach = reach - reach % 2

    def place(dx: Column, dy: Column) -> Column:
        even = lambda v: (v := E.clamp(v, -reach, reach)) - v.bitwiseAND(F.lit(1))
        return F.struct(even(dx).cast("int").alias("dx"), even(dy).cast("int").alias("dy"))

    steps = F.when(reach >= 2, F.sequence(F.lit(1), F.greatest(E.idiv(reach, 2).cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    arms = F.flatten(F.transform(steps, lambda k: F.array(place(x + 2 * k, y), place(x - 2 * k, y), place(x, y + 2 * k), place(x, y - 2 * k))))
    none = F.array(place(F.lit(0), F.lit(0)))
    corners = F.array(*[place(F.lit(a), F.lit(b)) for a in (2, -2) for b in (2, -2)])
    corners = F.when(reach >= 2, corners).otherwise(F.slice(corners, 1, 0))
    return F.slice(F.array_distinct(F.concat(none, arms, corners)), 1, most)


def motion_costs(df: DataFrame, reach: int = 2, quality: int = 78, samples: str = "samples", previous: str = "previous") -> DataFrame:
    """``df`` with costs: for each candidate of an 8x8 luma block the sampled difference with the block before it, and the bytes and squared
    error of its quantized transform. ``df`` has blocks of 64 bytes and the ones before, neither null."""
    a, b = df.columns.index(samples), df.columns.index(previous)
    tried, step = motion.cross(reach), T.steps(quality, 0)
    y, x = np.divmod(np.arange(64), 8)
    places = [np.clip(y + dy, 0, 7) * 8 + np.clip(x + dx, 0, 7) for dx, dy in tried]
    sampled = np.flatnonzero((y % 2 == 0) & (x % 2 == 0))

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        new, old = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64) for i in (a, b))
        out = []
        for (dx, dy), place in zip(tried, places):
            moved = old[:, place]
            levels = T.levels_of(new - moved, step)
            back = np.clip(moved + T.residuals(levels, step).reshape(-1, 64), 0, 255)
            out.append([np.full(len(new), len(out)), np.full(len(new), dx), np.full(len(new), dy), np.abs(new - moved)[:, sampled].sum(1), motion.level_sizes(levels), ((new - back) ** 2).sum(1)])
        flat = np.array(out, np.int64).reshape(len(tried), 6, -1).transpose(2, 0, 1).reshape(-1, 6)
        names, kinds = ("ord", "dx", "dy", "difference", "bytes", "distortion"), [pa.int32()] * 3 + [pa.int64()] * 3
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i], k) for i, k in enumerate(kinds)], names=list(names))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * len(tried)), rows)]

    return added(df, f"costs {COST}", of)


def chosen(costs: Column | str, finalists: int = 2) -> Column:
    """(dx, dy, cost) of a block: of no motion and the ``finalists`` of least difference, the one of least distortion and rate; the first of equals."""
    costs = E.col(costs)
    others = F.array_sort(F.transform(F.slice(costs, 2, F.size(costs)), lambda c: F.struct(c["difference"].alias("difference"), c["ord"].alias("ord"), c.alias("c"))))
    look = F.concat(F.slice(costs, 1, 1), F.transform(F.slice(others, 1, finalists), lambda o: o["c"]))
    total = lambda c: c["distortion"] + c["bytes"] + E.vector_rate(c["dx"], c["dy"])
    return F.array_min(F.transform(look, lambda c, i: F.struct(total(c).alias("cost"), i.alias("place"), c["dx"].alias("dx"), c["dy"].alias("dy"))))


def predicted(samples: Column | str, vectors: Column, width: int, height: int, cell: int) -> Column:
    """A picture's samples displaced cell by cell; ``vectors`` has a struct (dx, dy) for each cell, in raster order. Edges repeat."""
    samples, across = E.col(samples), -(-width // cell)

    def one(i: Column) -> Column:
        x, y = i % width, E.idiv(i, width)
        v = F.element_at(vectors, (cell_of(x, y, across, cell) + 1).cast("int"))
        return F.element_at(samples, (E.clamp(y - v["dy"], 0, height - 1) * width + E.clamp(x - v["dx"], 0, width - 1) + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)


def cell_of(x: Column, y: Column, across: int, size: int) -> Column:
    """Number of the grid cell that a sample lies in."""
    return E.idiv(y, size) * across + E.idiv(x, size)


def global_motion(df: DataFrame, width: int, height: int, reach: int, form: str, samples: str = "picture", previous: str = "previous") -> DataFrame:
    """``df`` with dx and dy: one displacement for each luma picture (bytes) against the one before it."""
    a, b = df.columns.index(samples), df.columns.index(previous)

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [motion.global_motion(motion.luma(x.as_py(), width, height), motion.luma(y.as_py(), width, height), reach, form) for x, y in zip(batch.column(a), batch.column(b))]
        return [pa.array([v[i] for v in found], pa.int32()) for i in (0, 1)]

    return added(df, "dx int, dy int", of)


def intra_choices(df: DataFrame, width: int, height: int, quality: int = 78, samples: str = "picture") -> DataFrame:
    """``df`` with blocks: for each 8x8 block of a luma picture, by its neighbours in the source, the rounded mean of the edges above and to
    the left (128 without any) and the predictor of the fewest bytes: 1 that mean, 2 the row above, 3 the column to the left; the first of equals."""
    at, step = df.columns.index(samples), T.steps(quality, 0)

    def one(picture: bytes) -> list[dict]:
        plane, out = motion.luma(picture, width, height), []
        for y in range(0, height, 8):
            for x in range(0, width, 8):
                block = plane[y : y + 8, x : x + 8]
                guesses = [T._predicted(plane, mode, x, y, *block.shape[::-1]) for mode in (1, 2, 3)]
                levels = np.concatenate([T.levels_of(T.padded(block - g), step) for g in guesses])
                sizes = motion.level_sizes(levels, tokens=False)
                best = int(sizes.argmin())
                out.append({"bx": x // 8, "by": y // 8, "mean": int(guesses[0]), "mode": best + 1, "bytes": int(sizes[best])})
        return out

    kind = "array<struct<bx:int,by:int,mean:int,mode:int,bytes:int>>"
    arrow = pa.list_(pa.struct([(n, pa.int32()) for n in ("bx", "by", "mean", "mode", "bytes")]))
    return added(df, f"blocks {kind}", lambda batch: [pa.array([one(x.as_py()) for x in batch.column(at)], arrow)])


def waves(width: Column, height: Column) -> Column:
    """Blocks of each wave of a plane: those whose neighbours above and to the left are all in earlier waves, counted by bx + by."""
    nx, ny = E.idiv(width + 7, 8), E.idiv(height + 7, 8)
    wave = F.sequence(F.lit(0).cast("long"), nx + ny - 2)
    return F.transform(wave, lambda k: F.least(k + 1, nx, ny, nx + ny - 1 - k))


def first_kept(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; rows are reduced before they travel."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"b.`{c}`") for c in [*order, *rest]])


def raster_order(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """``df`` once per block of its 4:2:0 picture, with plane, by, bx and place: their order in a payload. The place is
    computed, not counted, so no row waits for another."""
    half = lambda v: E.idiv(v, 2)
    sizes = [(width, height), (half(width), half(height)), (half(width), half(height))]
    grids = [(E.idiv(w + 7, 8), E.idiv(h + 7, 8)) for w, h in sizes]
    starts = [F.lit(0).cast("long"), grids[0][0] * grids[0][1], grids[0][0] * grids[0][1] + grids[1][0] * grids[1][1]]
    parts = F.array(*[F.struct(F.lit(p).alias("plane"), nx.alias("nx"), ny.alias("ny"), s.alias("start")) for p, ((nx, ny), s) in enumerate(zip(grids, starts))])
    names = df.columns
    df = df.withColumn("__p", F.explode(parts)).where("__p.nx > 0 and __p.ny > 0")
    df = df.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__p.nx") * F.col("__p.ny") - 1)))
    return df.select(*names, "__p.plane", E.idiv("__i", F.col("__p.nx")).alias("by"), (F.col("__i") % F.col("__p.nx")).alias("bx"), (F.col("__p.start") + F.col("__i")).alias("place"))


def first_samples(df: DataFrame, key: list[str], order: str, most: int = 12_000) -> DataFrame:
    """The first ``most`` samples of each key; later ones are not kept."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("__n") <= most).drop("__n")
