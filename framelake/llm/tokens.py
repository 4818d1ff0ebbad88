"""Whole Arrow batches of text as arrays of 64-bit word hashes.

Words are cut out and hashed for a slice of texts at once: a rolling polynomial over a
random byte table, whose prefix sums give every word's hash by one subtraction, then a
finishing mix. A slice holds about ``SLICE`` bytes of text, or one text, so memory doesn't
grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
ROOT = np.uint64(0x9E3779B97F4A7C15)
ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
END, BEGIN = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)

_spaces = np.zeros(256, bool)
_spaces[[32, *range(9, 14)]] = True
#: Which bytes separate words: ASCII whitespace, or everything in ASCII but letters and digits.
SPACES = _spaces
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_values = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_values[65:91] = _values[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finishing mix of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    return mix(a * np.uint64(0x2545F4914F6CDD1D) + (b ^ (b >> np.uint64(29))))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for name, base in (("up", ROOT), ("down", ROOT_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_slices(column: pa.Array, slice_bytes: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive texts; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        yield at, min(to, n), data[offsets[at] : offsets[min(to, n)]], offsets[at : min(to, n) + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end (in bytes of the slice) of each word and the number of words of each text.

    ASCII letters hash alike in either case. Hashes 0 and 1 never occur by design of the mix
    on odd sums; markers END and BEGIN are set apart by being no word's hash but by chance.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    word = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_values[data] * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(hashes), starts, ends, counts
