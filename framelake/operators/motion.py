"""Motion: candidates, scores, choices and predictions on small pictures held in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as E


def with_previous(df: DataFrame, key: list[str], order: str, samples: str = "samples") -> DataFrame:
    """``df`` with previous: the samples of the picture before."""
    return df.withColumn("previous", F.lag(samples).over(Window.partitionBy(*key).orderBy(order)))


def residual(samples: str = "samples", previous: str = "previous", quality: int = 78) -> Column:
    """Quantized differences of a picture with the one before it."""
    dead, step = E.by_quality(F.lit(quality), E.DEAD_ZONE_FAST), E.by_quality(F.lit(quality), E.RESIDUAL_STEPS)
    return F.zip_with(samples, previous, lambda a, b: E.quantize_residual(E.wrap8(a - b), dead, step))


def stride_places(width: int, height: int, stride: int) -> Column:
    return F.array(*[F.lit(y * width + x) for y in range(0, height, stride) for x in range(0, width, stride)])


def sampled_difference(width: int, height: int, stride: int, samples: str = "samples", previous: str = "previous") -> Column:
    """Mean absolute difference on a grid of places; null without a picture before."""
    places = [y * width + x for y in range(0, height, stride) for x in range(0, width, stride)]
    at = lambda c, p: F.element_at(c, p + 1)
    each = F.transform(stride_places(width, height, stride), lambda p: F.abs(at(F.col(samples), p) - at(F.col(previous), p)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.col(previous).isNotNull(), total / len(places))


def frame_decision(score: Column, frame_no: Column, quality: int, key_interval: int, scene: float) -> Column:
    """Type of a frame: 0 key, 1 predicted, 2 repeat, by its difference from the one before."""
    repeat = E.by_quality(F.lit(quality), E.REPEAT_FAST)
    return F.when(score.isNull() | (frame_no % key_interval == 0), 0).when(score <= repeat, 2).when(score < scene, 1).otherwise(0)


def block_score(dx: Column, dy: Column, width: int, height: int, stride: int, samples: str = "samples", previous: str = "previous") -> Column:
    """256 times the mean absolute difference with the picture before, displaced; edges repeat."""
    places = [(x, y) for y in range(0, height, stride) for x in range(0, width, stride)]
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in places])

    def difference(p: Column) -> Column:
        there = E.clamp(p["y"] - dy, 0, height - 1) * width + E.clamp(p["x"] - dx, 0, width - 1)
        return F.abs(F.element_at(samples, p["y"] * width + p["x"] + 1) - F.element_at(F.col(previous), there + 1))

    total = F.aggregate(F.transform(cells, difference), F.lit(0).cast("long"), lambda s, x: s + x)
    return E.idiv(total * 256, len(places))


def best_motion(df: DataFrame, key: list[str], width: int, height: int, search: int = 2, stride: int = 2) -> DataFrame:
    """``key``, zero_score, dx, dy, score and accepted: the least cost of the displacements tried, the first in raster order of
    equals, and whether it beats no motion by enough.

    Up to a search of 2 all displacements are tried. Beyond that every second one is, and then the places next to the best of
    them (next to none, if none of them beats it). Candidates are arrays of each row: nothing is joined.
    """
    inc = 1 if search <= 2 else 2
    offsets = [(dx, dy) for dy in range(-search, search + 1, inc) for dx in range(-search, search + 1, inc) if dx or dy]
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(offsets)])

    def cost(c: Column) -> Column:
        score = block_score(c["dx"], c["dy"], width, height, stride) + 24 * (F.abs(c["dx"]) + F.abs(c["dy"]))
        return F.struct(score.alias("score"), c["ord"].alias("ord"), c["dx"].alias("dx"), c["dy"].alias("dy"))

    zero = block_score(F.lit(0), F.lit(0), width, height, stride)
    found = df.where(F.col("previous").isNotNull()).withColumns({"zero_score": zero, "b": F.array_min(F.transform(cells, cost))})
    if inc > 1:
        beaten = F.col("b.score") < F.col("zero_score")
        at = lambda name: F.when(beaten, F.col(f"b.{name}")).otherwise(0)
        near = [(x, y) for y in (-1, 0, 1) for x in (-1, 0, 1)]
        around = F.array(*[F.struct(F.lit(1000 + i).alias("ord"), (at("dx") + x).alias("dx"), (at("dy") + y).alias("dy")) for i, (x, y) in enumerate(near)])
        inside = F.filter(around, lambda c: (F.abs(c["dx"]) <= search) & (F.abs(c["dy"]) <= search) & ((c["dx"] != 0) | (c["dy"] != 0)))
        found = found.withColumn("b", F.array_min(F.concat(F.array("b"), F.transform(inside, cost))))
    s, z = F.col("b.score"), F.col("zero_score")
    wins = (z > 256) & (s + 384 < z) & (s * 100 < z * 72)
    return found.select(*key, "zero_score", F.col("b.dx").alias("dx"), F.col("b.dy").alias("dy"), s.alias("score"), wins.alias("accepted"))


def shortlist(candidates: DataFrame, key: str, k: int) -> DataFrame:
    """The first candidate of each block (no motion) and the ``k`` of least distortion of the others, with their rank."""
    first = F.min("ord").over(Window.partitionBy(key))
    marked = candidates.withColumn("__zero", F.col("ord") == first)
    order = Window.partitionBy(key).orderBy(F.col("__zero").desc(), "distortion", "ord")
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("__zero")


def least_cost(candidates: DataFrame, key: str, weight: int = 1) -> DataFrame:
    """The candidate of least distortion plus weighted rate of each block, the first of equals; reduced before it travels."""
    cost = F.col("distortion") + weight * F.col("rate")
    best = F.min(F.struct(cost.alias("cost"), "ord", "distortion", "rate")).alias("b")
    return candidates.groupBy(key).agg(best).select(key, F.col("b.ord").alias("ord"), F.col("b.cost").alias("cost"), F.col("b.distortion").alias("distortion"), F.col("b.rate").alias("rate"))
