"""Distortion measures from exact integer sums and one division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(sse: Column, n: Column) -> Column:
    return F.try_divide(sse.cast("double"), n.cast("double"))


def psnr(sse: Column, n: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB of pooled samples; infinite without noise."""
    return F.when(sse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / mse(sse, n)))


def snr(signal: Column, noise: Column) -> Column:
    """Signal-to-noise ratio in dB of sums of squares; infinite without noise."""
    return F.when(noise == 0, F.lit(float("inf"))).otherwise(10 * F.log10(signal.cast("double") / noise.cast("double")))


def pooled(df: DataFrame, key: list[str], sse: str = "sse", n: str = "n") -> DataFrame:
    """Sums over all blocks of a key, then MSE and PSNR."""
    out = df.groupBy(*key).agg(F.sum(sse).alias("sse"), F.sum(n).alias("samples"))
    return out.withColumns({"mse": mse(F.col("sse"), F.col("samples")), "psnr_db": psnr(F.col("sse"), F.col("samples"))})


def compared(source: DataFrame, decoded: DataFrame, key: list[str], samples: str = "samples") -> DataFrame:
    """SSE of pictures or blocks of two tables, where both have the key; up to the shorter one's length."""
    a = source.select(*key, F.col(samples).alias("__a"))
    b = decoded.select(*key, F.col(samples).alias("__b"))
    n = F.least(F.size("__a"), F.size("__b"))
    each = F.zip_with(F.slice("__a", F.lit(1), n), F.slice("__b", F.lit(1), n), lambda x, y: (x.cast("long") - y) * (x.cast("long") - y))
    return a.join(b, key).select(*key, F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("sse"), n.alias("n"))
