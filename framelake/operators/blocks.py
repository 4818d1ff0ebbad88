"""8x8 transform blocks: Walsh-Hadamard kernel, quantizer, scan order, distortion.

The transform of a whole Arrow batch of blocks is one matrix product, exact in doubles for
any sample range in use, so a block never leaves its row: no shuffle, no explosion into samples.
What comes after it is array functions, which Spark interprets row by row; no row is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import exprs as E

# Sequency order of the Hadamard rows.
SEQUENCY = [0, 4, 6, 2, 3, 7, 5, 1]


def scan_order(n: int = 8) -> list[int]:
    """Raster places of an n x n block along its antidiagonals, in turn upwards and downwards."""
    out = []
    for d in range(2 * n - 1):
        cells = [(d - x, x) for x in range(n) if 0 <= d - x < n]
        out += [y * n + x for y, x in (cells if d % 2 == 0 else cells[::-1])]
    return out


SCAN = scan_order()


def sign_matrix() -> np.ndarray:
    """The 2-D transform: 64 coefficients (v * 8 + u) by 64 samples (y * 8 + x) of +1 and -1."""
    one = np.array([[(-1) ** bin(k & u).count("1") for k in range(8)] for u in SEQUENCY])
    return np.kron(one, one)


def _mapped(df: DataFrame, source: str, target: str, f) -> DataFrame:
    place = df.columns.index(source)
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64)
            whole = pa.array(f(x).astype(np.int64).ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 64, pa.int32()), whole)
            if column.null_count:
                lengths = np.where(np.asarray(column.is_valid()), 64, 0)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole, mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, target])

    return df.mapInArrow(batches, f"{fields}, `{target}` array<long>")


def forward(df: DataFrame, samples: str = "samples", target: str = "coeffs") -> DataFrame:
    """``df`` with the 64 coefficients of each block of 64 samples; null stays null."""
    signs = sign_matrix().T.astype(np.float64)
    return _mapped(df, samples, target, lambda x: x @ signs)


def inverse(df: DataFrame, coeffs: str = "coeffs", target: str = "restored") -> DataFrame:
    """``df`` with the samples of each block of coefficients: a 64th, rounded half away from zero."""
    signs = sign_matrix().astype(np.float64)

    def back(x: np.ndarray) -> np.ndarray:
        sums = x @ signs
        return np.sign(sums) * np.floor((np.abs(sums) + 32) / 64)

    return _mapped(df, coeffs, target, back)


def quantized(coeffs: Column | str, step: Column | str) -> Column:
    return F.zip_with(coeffs, step, lambda c, s: E.div_round(c, s))


def dequantized(levels: Column | str, step: Column | str) -> Column:
    return F.zip_with(levels, step, lambda q, s: q * s)


def scanned(levels: Column | str) -> Column:
    """The levels in scan order."""
    levels = E.col(levels)
    return F.transform(F.array(*map(F.lit, SCAN)), lambda i: F.element_at(levels, i + 1))


def run_levels(scan: Column | str) -> Column:
    """(pos, run, level) of each nonzero level of a scan: run counts the zeros before it."""
    scan = E.col(scan)
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<pos:int,run:int,level:bigint>>").alias("out"))
    pairs = F.filter(F.transform(scan, lambda level, i: F.struct(i.alias("pos"), level.alias("level"))), lambda p: p["level"] != 0)

    def step(acc: Column, p: Column) -> Column:
        token = F.struct(p["pos"].alias("pos"), (p["pos"] - acc["last"] - 1).alias("run"), p["level"].cast("long").alias("level"))
        return F.struct(p["pos"].alias("last"), F.concat(acc["out"], F.array(token)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def squared_error(a: Column | str, b: Column | str) -> Column:
    each = F.zip_with(a, b, lambda x, y: (x.cast("long") - y) * (x.cast("long") - y))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)


def total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def coded_bytes(tokens: Column | str) -> Column:
    """Bytes of a block as a last index and varint runs and levels; nothing if all are zero."""
    each = F.transform(tokens, lambda t: E.varint_size(t["run"]) + E.varint_size(E.zigzag(t["level"])))
    return F.when(F.size(tokens) == 0, F.lit(0).cast("long")).otherwise(1 + total(each))


def coded_bits(tokens: Column | str) -> Column:
    """Bits of a block as a 6-bit last index, unary runs and Rice levels; nothing if all are zero."""
    each = F.transform(tokens, lambda t: E.level_bits(t["run"], t["level"]))
    return F.when(F.size(tokens) == 0, F.lit(0).cast("long")).otherwise(6 + total(each))


def with_qualities(df: DataFrame, qualities: tuple[int, ...], chroma: bool = False) -> DataFrame:
    """``df`` once per quality, with quality and step, its 64 quantizer steps as a constant."""
    each = [F.struct(F.lit(q).alias("quality"), F.array(*[F.lit(s).cast("long") for s in E.transform_steps(q, chroma)]).alias("step")) for q in qualities]
    return df.withColumn("__q", F.explode(F.array(*each))).select("*", "__q.quality", "__q.step").drop("__q")
