"""Sizes of a 64-byte residual block under the block modes, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as E


def rice_bytes(sums: Column, k: Column) -> Column:
    """Bytes of 64 Rice codes, from the sums of the codes shifted right by 0 to 5."""
    return E.idiv(F.element_at(sums, (k + 1).cast("int")) + 64 * (1 + k) + 7, 8)


def with_modes(df: DataFrame, rice: bool = False) -> DataFrame:
    """``df`` (with the columns of kernels.code_statistics) and mode and mode_bytes: the smallest way to store each block,
    the first of equals in the order fixed width, sparse, Rice.

    Mode 0 is an all-zero block, 1 to 8 a fixed width, 9 a bitmap and the nonzero codes, 10 and up
    Rice codes of k = mode - 10, for three k around one that the mean suggests.
    """
    width, nz = F.col("width"), F.col("nonzero")
    ways = [F.struct((8 * width).cast("long").alias("bytes"), F.lit(0).alias("ord"), width.alias("mode"))]
    ways.append(F.struct((8 + nz).cast("long").alias("bytes"), F.lit(1).alias("ord"), F.lit(9).alias("mode")))
    # one step per projection, so that nothing is computed again for each use
    names = df.columns
    if rice:
        df = df.withColumn("__mean", F.least(E.idiv(F.col("code_sum") + 32, 64), F.lit(255).cast("long")))
        df = df.withColumn("__k", E.clamp(E.bit_width("__mean") - 2, 0, 5))
        df = df.withColumns({f"__k{i}": E.clamp(F.col("__k") + d, 0, 5) for i, d in enumerate((-1, 0, 1))})
        df = df.withColumns({f"__r{i}": F.when(width > 0, rice_bytes(F.col("rice"), F.col(f"__k{i}"))) for i in range(3)})
        ways += [F.struct(F.col(f"__r{i}").alias("bytes"), F.lit(2 + i).alias("ord"), (10 + F.col(f"__k{i}")).alias("mode")) for i in range(3)]
    df = df.withColumn("__best", F.array_min(F.array(*ways)))
    zero, best = width == 0, F.col("__best")
    return df.select(*names, F.when(zero, 0).otherwise(best["mode"]).alias("mode"), F.when(zero, 0).otherwise(best["bytes"]).cast("long").alias("mode_bytes"))


def zero_run_bytes(values: Column | str) -> Column:
    """Bytes of up to 128 values with runs of three or more zeros folded: a token for each run, and for each stretch between
    them a token and its values."""
    marks = F.array_join(F.transform(E.col(values), lambda v: F.when(v == 0, "0").otherwise("1")), "")
    stretches = F.filter(F.split(marks, "0{3,}"), lambda s: F.length(s) > 0)
    return (F.regexp_count(marks, F.lit("0{3,}")) + F.size(stretches) + F.length(F.array_join(stretches, ""))).cast("long")


def run_bytes(runs: Column, items: Column, width: int) -> list[Column]:
    """(bytes, folded) of a list of items of ``width`` bytes: as it is, or as runs of one byte more each, if that is shorter."""
    return [F.least(items * width, runs * (width + 1)), runs * (width + 1) < items * width]
