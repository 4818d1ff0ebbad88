"""Block-predictive audio: anchors, scales, levels, codes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as E

BLOCK = 32
#: Largest code of each width, and the bias that makes codes unsigned.
LIMITS = {8: (127, 128), 6: (31, 32)}


def blocks(pcm: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """(key, block, samples): samples (key, n, sample) in arrays of ``block``, the last one shorter."""
    which = E.idiv("n", block).alias("block")
    return pcm.groupBy(*key, which).agg(F.array_sort(F.collect_list(F.struct("n", "sample"))).alias("s")).select(*key, "block", F.col("s.sample").alias("samples"))


def with_scale(df: DataFrame, bits: int = 8) -> DataFrame:
    """``df`` with anchor (first sample), max_delta and scale (least that keeps each step within the codes)."""
    limit = LIMITS[bits][0]
    s = F.col("samples")
    before = F.concat(F.slice(s, 1, 1), F.slice(s, 1, F.size(s) - 1))
    delta = F.array_max(F.zip_with(s, before, lambda x, y: F.abs(x - y)))
    return df.withColumns({"anchor": F.element_at(s, 1), "max_delta": delta, "scale": F.greatest(F.lit(1).cast("long"), E.idiv(delta + limit - 1, limit))})


def with_codes(df: DataFrame, bits: int = 8, rounds: int = 4) -> DataFrame:
    """``df`` (with scale) with levels and codes: rounded levels above the anchor, and their
    differences plus the bias.

    Rounding can push a difference past the limit; the scale then grows by the factor it is over, at
    most ``rounds`` - 1 times, and what is still over is clipped.
    """
    limit, bias = LIMITS[bits]
    for i in range(rounds):
        scale, anchor = F.col("scale"), F.col("anchor")
        df = df.withColumn("levels", F.transform("samples", lambda x: E.div_round(x - anchor, scale)))
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice("levels", 1, F.size("levels") - 1))
        df = df.withColumn("steps", F.zip_with("levels", before, lambda x, y: x - y))
        over = E.idiv(F.array_max(F.transform("steps", lambda x: F.abs(x))) + limit - 1, limit)
        if i < rounds - 1:
            df = df.withColumn("scale", scale * F.greatest(F.lit(1).cast("long"), over))
    return df.withColumn("codes", F.transform("steps", lambda x: (E.clamp(x, -limit, limit) + bias).cast("int"))).drop("steps")


def decoded(codes: Column | str, anchor: Column | str, scale: Column | str, bits: int = 8) -> Column:
    """Samples of a block: prefix sums of the codes, scaled, above the anchor, clipped to 16 bits."""
    anchor, scale = E.col(anchor), E.col(scale)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, code: Column) -> Column:
        level = acc["at"] + code - LIMITS[bits][1]
        sample = E.clamp(anchor + level * scale, -32768, 32767).cast("int")
        return F.struct(level.cast("long").alias("at"), F.concat(acc["out"], F.array(sample)).alias("out"))

    return F.aggregate(codes, start, step)["out"]


def packed6(codes: Column | str) -> Column:
    """Each four 6-bit codes as one number of 24 bits, the first code lowest; zeros fill up."""
    codes = E.col(codes)
    at = lambda i: F.coalesce(F.try_element_at(codes, i), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), E.idiv(F.size(codes) - 1, 4).cast("int")),
        lambda g: at(g * 4 + 1) + at(g * 4 + 2) * 64 + at(g * 4 + 3) * 4096 + at(g * 4 + 4) * 262144,
    )


def unpacked6(packed: Column | str) -> Column:
    return F.flatten(F.transform(packed, lambda p: F.array(*[E.idiv(p, 1 << 6 * i) % 64 for i in range(4)])))
