"""Variable-length integers and bit streams, least significant bit first."""

from __future__ import annotations


class Malformed(ValueError):
    """A payload that breaks a rule of its format."""


class Bytes:
    """A cursor over a payload; reading past its end is an error."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end
        if self.end > len(data):
            raise Malformed("section past the end")

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Malformed("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def uint(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def varint(self) -> int:
        value = 0
        for i in range(5):
            b = self.u8()
            value |= (b & 127) << 7 * i
            if b < 128:
                return value
        raise Malformed("varint too long")

    def done(self) -> None:
        if self.at != self.end:
            raise Malformed("trailing bytes")


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def zigzag(v: int) -> int:
    return -2 * v - 1 if v < 0 else 2 * v


def unzigzag(z: int) -> int:
    return -((z + 1) >> 1) if z & 1 else z >> 1


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def get(self, n: int) -> int:
        if n > self.left:
            raise Malformed("truncated bits")
        out = self.value & (1 << n) - 1
        self.value >>= n
        self.left -= n
        return out

    def zeros(self, most: int) -> int:
        """Zero bits before the next one bit, which is read as well."""
        low = self.value & (1 << most + 1) - 1
        if not low:
            raise Malformed("run of zeros too long")
        n = (low & -low).bit_length() - 1
        self.get(n + 1)
        return n

    def align(self) -> None:
        self.get(self.left % 8)


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def zeros(self, n: int) -> None:
        self.put(1 << n, n + 1)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")
