"""Computations along an order: deltas and their inverse, runs, prefixes, offsets, predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import exprs as E


def delta_mod256(data: Column | str) -> Column:
    """Differences of neighbouring bytes modulo 256; the first as it is."""
    data = E.col(data)
    before = F.concat(F.array(F.lit(0)), F.slice(data, 1, F.greatest(F.size(data) - 1, F.lit(0))))
    return F.zip_with(data, before, lambda x, y: F.pmod(x - y, F.lit(256)))


def restore_mod256(delta: Column | str) -> Column:
    """The bytes whose differences these are."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        v = F.pmod(acc["at"] + d, F.lit(256)).cast("int")
        return F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out"))

    return F.aggregate(delta, start, step)["out"]


def islands(df: DataFrame, key: list[str], order: str, value: str, longest: int = 256) -> DataFrame:
    """(key, start, value, run): runs of equal values along the order, cut after ``longest``.

    One window pass finds where a value changes, a second one numbers the islands; each
    island is then cut by its rows' numbers.
    """
    w = Window.partitionBy(*key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.select(*key, order, value, F.row_number().over(w).alias("__n"), F.when(changed, F.row_number().over(w)).alias("__c"))
    first = F.max("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__first", first).withColumn("__piece", E.idiv(F.col("__n") - F.col("__first"), longest))
    runs = marked.groupBy(*key, "__first", "__piece").agg(F.min(order).alias("start"), F.first(value).alias(value), F.count("*").alias("run"))
    return runs.drop("__first", "__piece")


def valid_prefix(df: DataFrame, key: list[str], order: str, valid: Column) -> DataFrame:
    """The rows before the first invalid one of each key."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(F.coalesce(valid, F.lit(False)).cast("int")).over(w)).where("__ok = 1").drop("__ok")


def record_offsets(df: DataFrame, key: list[str], order: str, size: str, head: int = 32, start: int = 96) -> DataFrame:
    """``df`` with record_offset: where each record starts, after a file head of ``start`` bytes."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("record_offset", F.coalesce(F.sum(F.col(size) + head).over(w), F.lit(0)) + start)


def running_before(df: DataFrame, key: list[str], order: str, value: str, target: str) -> DataFrame:
    """``df`` with ``target``: the sum of ``value`` over the rows of the key before each."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(target, F.coalesce(F.sum(value).over(w), F.lit(0)))


def groups_of_pictures(df: DataFrame, key: list[str], order: str, kind: str = "frame_type") -> DataFrame:
    """``df`` with gop (key frames up to here) and since_key (frames since the last one; null before the first)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(kind) == 0, F.col(order)), ignorenulls=True).over(w)
    return df.withColumns({"gop": F.count_if(F.col(kind) == 0).over(w), "since_key": F.col(order) - last})


def not_rising(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The rows whose value is not above that of the row before."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__before", F.lag(value).over(w)).where(F.col(value) <= F.col("__before")).drop("__before")


def grid_median(values: Column | str, width: int, height: int, corner: str = "right") -> Column:
    """For each value of a grid in raster order the median of its left, upper and upper right (or upper left) neighbour. A missing
    neighbour is 0; a missing upper right one is the upper one. The grid is one row's array, so nothing is joined."""
    values = E.col(values)

    def one(i: Column) -> Column:
        x, y = i % width, E.idiv(i, width)
        at = lambda dx, dy, inside: F.when(inside, F.element_at(values, (i + 1 + dx + dy * width).cast("int")))
        top = F.coalesce(at(0, -1, y > 0), F.lit(0))
        side = F.coalesce(at(1, -1, (y > 0) & (x < width - 1)), top) if corner == "right" else F.coalesce(at(-1, -1, (y > 0) & (x > 0)), F.lit(0))
        return E.median3(F.coalesce(at(-1, 0, x > 0), F.lit(0)), top, side)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)
