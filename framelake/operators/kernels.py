"""Arrow kernels over 64-byte blocks: whole batches as matrices, one pass, no shuffle.

Running sums and sums over bits of a block are one array operation here; as array lambdas they would be
interpreted element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A matrix as an array of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind or pa.int32()))


def bytes_of(column: pa.Array) -> np.ndarray:
    """A column of 64-byte binaries as a matrix; null is a block of zeros."""
    return np.frombuffer(b"".join(v.as_py() or bytes(BLOCK) for v in column), np.uint8).reshape(-1, BLOCK)


def added(df: DataFrame, schema: str, of: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``of`` makes of each batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *of(batch)], names=[*batch.schema.names, *names])

    return df.mapInArrow(batches, f"{fields}, {schema}")


def byte_deltas(df: DataFrame, data: str = "data", before: str | None = None) -> DataFrame:
    """``df`` with delta: differences of neighbouring bytes modulo 256. The first byte of a block is compared with the column
    ``before``, if given, else with 0."""
    at, first = df.columns.index(data), df.columns.index(before) if before else None

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        x = bytes_of(batch.column(at)).astype(np.int32)
        start = np.zeros(len(x), np.int32) if first is None else batch.column(first).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        return [lists(np.diff(x, axis=1, prepend=start[:, None]) % 256)]

    return added(df, "delta array<int>", of)


def byte_sums(df: DataFrame, delta: str = "delta", before: str | None = None) -> DataFrame:
    """``df`` with bytes: running sums of a block's differences modulo 256, from the column ``before`` on, if given; the inverse of byte_deltas."""
    at, first = df.columns.index(delta), df.columns.index(before) if before else None

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BLOCK)
        start = 0 if first is None else batch.column(first).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
        return [lists((np.cumsum(x, axis=1) + start) % 256)]

    return added(df, "bytes array<int>", of)


def row_deltas(df: DataFrame, samples: str = "samples", width: int = 8, back: bool = False) -> DataFrame:
    """``df`` with delta: along each row of a block of samples the differences modulo 256, the first sample as it is; or, ``back``, restored: their running sums."""
    at = df.columns.index(samples)

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1, width)
        y = np.cumsum(x, axis=2) if back else np.diff(x, axis=2, prepend=0)
        return [lists((y % 256).reshape(batch.num_rows, -1))]

    return added(df, f"{'restored' if back else 'delta'} array<int>", of)


def code_statistics(df: DataFrame, data: str = "data", delta: bool = True) -> DataFrame:
    """``df`` with, for the zig-zag codes of a block's bytes (or of their differences): width (bits of the largest), nonzero,
    code_sum, and rice: the sums of the codes shifted right by 0 to 5."""
    at = df.columns.index(data)

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        x = bytes_of(batch.column(at)).astype(np.int64)
        x = np.diff(x, axis=1, prepend=0) if delta else x
        v = (x + 128) % 256 - 128
        z = np.minimum(np.where(v < 0, -2 * v - 1, 2 * v), 255)
        most = z.max(1) if len(z) else np.zeros(0, np.int64)
        width = sum((most >= 1 << i).astype(np.int32) for i in range(8)) + np.zeros(len(z), np.int32)
        rice = np.stack([(z >> k).sum(1) for k in range(6)], 1)
        return [pa.array(width, pa.int32()), pa.array((z != 0).sum(1), pa.int32()), pa.array(z.sum(1), pa.int64()), lists(rice, pa.int64())]

    return added(df, "width int, nonzero int, code_sum long, rice array<long>", of)
