"""Byte-residual pictures (generations 3 to 6): zero-run wrapper, block modes, motion map."""

from __future__ import annotations

import numpy as np

from framelake.codecs.bits import BitReader, BitWriter, Bytes, Malformed
from framelake.codecs.transform import planes, split_planes

# Payload marks.
WRAPPED, BLOCKS, MOTION_MAP = b"ZP06", b"GBP6", b"GPM6"
GROUPED, GROUPED_RUNS, CHUNKED = b"GBP3", b"GBP4", b"GBP5"
BLOCK, CHUNK, CELL = 64, 256, 32


def unwrap(data: bytes) -> bytes:
    """A payload without its zero-run wrapper, if it has one."""
    if data[:4] != WRAPPED:
        return data
    cursor = Bytes(data, 4)
    size, out = cursor.uint(4), bytearray()
    while cursor.at < cursor.end:
        token = cursor.u8()
        out += bytes((token & 127) + 3) if token > 127 else cursor.take(token + 1)
        if len(out) > size:
            raise Malformed("more than the size says")
    if len(out) != size:
        raise Malformed("less than the size says")
    return bytes(out)


def wrap(data: bytes) -> bytes:
    """The payload with runs of three or more zeros folded, if that is smaller."""
    out, at = bytearray(), 0
    start = 0

    def literals(end: int) -> None:
        for a in range(start, end, 128):
            part = data[a : min(end, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(data):
        end = at
        while end < len(data) and not data[end] and end - at < 130:
            end += 1
        if end - at >= 3:
            literals(at)
            out.append(128 | end - at - 3)
            at = start = end
        else:
            at = max(end, at + 1)
    literals(len(data))
    whole = WRAPPED + len(data).to_bytes(4, "little") + bytes(out)
    return whole if len(whole) < len(data) else data


def _codes(blocks: np.ndarray) -> np.ndarray:
    v = (blocks.astype(np.int64) + 128) % 256 - 128
    return np.minimum(np.where(v < 0, -2 * v - 1, 2 * v), 255)


def pack_blocks(data: bytes, delta: bool = False) -> bytes:
    """Residual bytes as chunks of 64-byte blocks, each in its smallest mode, the first of equals."""
    n = -(-len(data) // BLOCK)
    blocks = np.frombuffer(data + bytes(-len(data) % BLOCK), np.uint8).reshape(n, BLOCK).astype(np.int64)
    if delta:
        blocks = np.diff(blocks, axis=1, prepend=0)
    codes = _codes(blocks)
    out = bytearray(BLOCKS + BLOCK.to_bytes(2, "little") + bytes(2) + len(data).to_bytes(4, "little") + n.to_bytes(4, "little") + CHUNK.to_bytes(2, "little") + bytes(2))
    for a in range(0, n, CHUNK):
        modes, body = zip(*(_block(c) for c in codes[a : a + CHUNK]))
        described, folded = _described(modes)
        payload = b"".join(body)
        out += len(modes).to_bytes(2, "little") + len(described).to_bytes(2, "little") + len(payload).to_bytes(4, "little") + bytes([folded | delta << 1, 0, 0, 0]) + described + payload
    return bytes(out)


def runs_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal rows, cut after 256."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).reshape(n - 1, -1).any(1))))
    size = np.diff(start, append=n)
    pieces = -(-size // 256)
    first = np.repeat(start, pieces) + 256 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.diff(first, append=n)


def _described(modes) -> tuple[bytes, bool]:
    """Block modes as half bytes, or as runs if that is shorter."""
    modes = list(modes)
    raw = bytes(m | (modes[i + 1] << 4 if i + 1 < len(modes) else 0) for i, m in enumerate(modes) if i % 2 == 0)
    first, size = runs_of(np.array(modes, np.int64))
    runs = bytes(v for i, n in zip(first.tolist(), size.tolist()) for v in (modes[i], n - 1))
    return (runs, True) if len(runs) < len(raw) else (raw, False)


def pack_motion_map(vectors: np.ndarray) -> tuple[bytes, bool]:
    """Vectors (n, 2) as signed bytes, or as runs of equal ones if that is shorter."""
    raw = np.asarray(vectors, np.int64).astype(np.int8)
    first, size = runs_of(raw)
    runs = b"".join(raw[i].tobytes() + bytes([n - 1]) for i, n in zip(first, size.tolist()))
    return (runs, True) if len(runs) < raw.nbytes else (raw.tobytes(), False)


def _block(codes: np.ndarray) -> tuple[int, bytes]:
    width = int(codes.max()).bit_length()
    if not width:
        return 0, b""
    nonzero = int((codes != 0).sum())
    ways = [(8 * width, 0, width), (8 + nonzero, 1, 9)]
    k0 = min(max(min((int(codes.sum()) + 32) // 64, 255).bit_length() - 2, 0), 5)
    for i, k in enumerate(min(max(k0 + d, 0), 5) for d in (-1, 0, 1)):
        ways.append(((int((codes >> k).sum()) + 64 * (1 + k) + 7) // 8, 2 + i, 10 + k))
    mode = min(ways)[2]
    return mode, _stored(codes, mode)


def _stored(codes: np.ndarray, mode: int) -> bytes:
    """The codes of a block in a mode."""
    if mode == 9:
        return np.packbits(codes != 0, bitorder="little").tobytes() + codes[codes != 0].astype(np.uint8).tobytes()
    bits = BitWriter()
    for c in codes.tolist():
        if mode < 9:
            bits.put(c, mode)
        else:
            bits.zeros(c >> mode - 10)
            bits.put(c & (1 << mode - 10) - 1, mode - 10)
    return bits.bytes()


def unpack_blocks(data: bytes) -> bytes:
    """Residual bytes of chunked blocks; the older of the two forms has no Rice modes."""
    cursor = Bytes(data)
    mark = cursor.take(4)
    if mark not in (BLOCKS, CHUNKED) or cursor.uint(2) != BLOCK or cursor.uint(2):
        raise Malformed("bad block head")
    most = 15 if mark == BLOCKS else 9
    size, n, per, zero = cursor.uint(4), cursor.uint(4), cursor.uint(2), cursor.uint(2)
    if n != -(-size // BLOCK) or per != CHUNK or zero:
        raise Malformed("bad block head")
    rows = []
    while len(rows) < n:
        count, described, payload, flags = cursor.uint(2), cursor.uint(2), cursor.uint(4), cursor.u8()
        if any(cursor.take(3)) or flags > 3 or count != min(CHUNK, n - len(rows)):
            raise Malformed("bad chunk head")
        modes = _modes(Bytes(cursor.take(described)), count, flags & 1, most)
        body = Bytes(cursor.take(payload))
        for mode in modes:
            z = _unblock(body, mode)
            v = np.where(z % 2, -((z + 1) // 2), z // 2)
            rows.append((np.cumsum(v) if flags & 2 else v) % 256)
        body.done()
    cursor.done()
    return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.uint8).tobytes()[:size]


def unpack_grouped(data: bytes) -> bytes:
    """Residual bytes of the two oldest forms: blocks of one width together, widths rising, sparse blocks last."""
    cursor = Bytes(data)
    mark = cursor.take(4)
    if mark not in (GROUPED, GROUPED_RUNS) or cursor.uint(2) != BLOCK:
        raise Malformed("bad block head")
    flags, size, n = cursor.uint(2), cursor.uint(4), cursor.uint(4)
    if n != -(-size // BLOCK) or flags > (3 if mark == GROUPED_RUNS else 0):
        raise Malformed("bad block head")
    described = cursor.uint(4) if mark == GROUPED_RUNS else (n + 1) // 2
    modes = np.array(_modes(Bytes(cursor.take(described)), n, flags & 1, 9), np.int64)
    codes = np.zeros((n, BLOCK), np.int64)
    for mode in range(1, 10):
        for i in np.flatnonzero(modes == mode):
            codes[i] = _unblock(cursor, mode)
    cursor.done()
    v = np.where(codes % 2, -((codes + 1) // 2), codes // 2).ravel()[:size]
    return ((np.cumsum(v) if flags & 2 else v) % 256).astype(np.uint8).tobytes()


def pack_grouped(data: bytes, runs: bool = True, delta: bool = False) -> bytes:
    """The inverse of unpack_grouped, in the form with (or without) folded modes."""
    n = -(-len(data) // BLOCK)
    v = np.frombuffer(data, np.uint8).astype(np.int64)
    v = np.diff(v, prepend=0) if delta and runs else v
    codes = _codes(np.concatenate([v, np.zeros(-len(v) % BLOCK, np.int64)]).reshape(n, BLOCK))
    modes, bodies = [], {}
    for i, c in enumerate(codes):
        width, nonzero = int(c.max()).bit_length(), int((c != 0).sum())
        mode = 9 if width and 8 + nonzero < 8 * width else width
        modes.append(mode)
        bodies.setdefault(mode, bytearray()).extend(_stored(c, mode))
    raw, folded = _described(modes) if runs else (bytes(m | (modes[i + 1] << 4 if i + 1 < n else 0) for i, m in enumerate(modes) if i % 2 == 0), False)
    flags = folded | (2 if delta and runs else 0)
    head = (GROUPED_RUNS if runs else GROUPED) + BLOCK.to_bytes(2, "little") + flags.to_bytes(2, "little") + len(data).to_bytes(4, "little") + n.to_bytes(4, "little")
    return head + (len(raw).to_bytes(4, "little") if runs else b"") + raw + b"".join(bytes(bodies[m]) for m in sorted(bodies) if m)


def _modes(cursor: Bytes, count: int, folded: int, most: int = 15) -> list[int]:
    out = []
    while cursor.at < cursor.end:
        b = cursor.u8()
        out += [b] * (cursor.u8() + 1) if folded else [b & 15, b >> 4]
    if not folded and len(out) == count + 1 and not out[-1]:
        out.pop()
    if len(out) != count or max(out, default=0) > most:
        raise Malformed("bad block modes")
    return out


def _unblock(body: Bytes, mode: int) -> np.ndarray:
    if not mode:
        return np.zeros(BLOCK, np.int64)
    if mode < 9:
        bits = np.unpackbits(np.frombuffer(body.take(8 * mode), np.uint8), bitorder="little").reshape(BLOCK, mode)
        return bits.astype(np.int64) @ (1 << np.arange(mode))
    if mode == 9:
        held = np.unpackbits(np.frombuffer(body.take(8), np.uint8), bitorder="little").astype(bool)
        out = np.zeros(BLOCK, np.int64)
        out[held] = np.frombuffer(body.take(int(held.sum())), np.uint8)
        return out
    k, reader = mode - 10, BitReader(body.data[body.at : body.end])
    out = np.zeros(BLOCK, np.int64)
    for i in range(BLOCK):
        z = reader.zeros(255 >> k) << k
        out[i] = z | reader.get(k)
    reader.align()
    body.at = body.end - reader.left // 8
    return out


def _rest(data: bytes) -> bytes:
    return unpack_grouped(data) if data[:4] in (GROUPED, GROUPED_RUNS) else unpack_blocks(data)


def decode(data: bytes, width: int, height: int, previous: bytes | None, key: bool, shift: tuple[int, int] = (0, 0)) -> bytes:
    """The picture of a payload of generations 3 to 6; ``shift`` is the whole picture's motion where the record has one."""
    data = unwrap(data)
    if key:
        rest, out = _rest(data), []
        if len(rest) != width * height * 3 // 2:
            raise Malformed("size doesn't fit the picture")
        for plane in split_planes(rest, width, height):
            out.append((np.cumsum(plane, axis=1) % 256).astype(np.uint8).tobytes())
        return b"".join(out)
    if previous is None:
        raise Malformed("predicted picture without one before it")
    nx, ny = -(-width // CELL), -(-height // CELL)
    vectors = np.tile(np.array(shift, np.int64), (ny * nx, 1))
    if data[:4] == MOTION_MAP:
        cursor = Bytes(data, 4)
        size, flags, gw, gh, motion, rest = (cursor.uint(k) for k in (2, 2, 2, 2, 4, 4))
        if size != CELL or flags > 1 or (gw, gh) != (nx, ny):
            raise Malformed("bad motion head")
        vectors, data = _motion(cursor.take(motion), nx * ny, flags), cursor.take(rest)
        cursor.done()
    rest = _rest(data)
    if len(rest) != width * height * 3 // 2:
        raise Malformed("size doesn't fit the picture")
    vectors, out = vectors.reshape(ny, nx, 2), []
    parts = zip(split_planes(previous, width, height), split_planes(rest, width, height), planes(width, height))
    for p, (old, add, (w, h)) in enumerate(parts):
        cell = CELL // 2 if p else CELL
        y, x = np.arange(h), np.arange(w)
        v = vectors[np.minimum(y // cell, ny - 1)][:, np.minimum(x // cell, nx - 1)]
        if p:
            v = np.sign(v) * (np.abs(v) // 2)
        there = old[np.clip(y[:, None] - v[..., 1], 0, h - 1), np.clip(x[None] - v[..., 0], 0, w - 1)]
        out.append(((there + add) % 256).astype(np.uint8).tobytes())
    return b"".join(out)


def _motion(data: bytes, n: int, folded: int) -> np.ndarray:
    width = 3 if folded else 2
    if len(data) % width:
        raise Malformed("bad motion map")
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    v = rows[:, :2].view(np.int8).astype(np.int64)
    v = np.repeat(v, rows[:, 2].astype(np.int64) + 1, axis=0) if folded else v
    if len(v) != n:
        raise Malformed("bad motion map")
    return v


def row_residual(picture: bytes, width: int, height: int) -> bytes:
    """Differences along each row of each plane, modulo 256, the first sample as it is."""
    return b"".join((np.diff(p, axis=1, prepend=0) % 256).astype(np.uint8).tobytes() for p in split_planes(picture, width, height))


def moved_picture(previous: bytes, width: int, height: int, vectors: np.ndarray) -> bytes:
    """The picture before, each cell displaced by its vector; what a payload without residual decodes to."""
    nx, ny = -(-width // CELL), -(-height // CELL)
    raw = np.asarray(vectors, np.int64).astype(np.int8).tobytes()
    empty = pack_blocks(bytes(width * height * 3 // 2))
    return decode(_motion_head(nx, ny, False, raw, empty) + raw + empty, width, height, previous, False)


def _motion_head(nx: int, ny: int, folded: bool, motion: bytes, rest: bytes) -> bytes:
    return MOTION_MAP + b"".join(int(v).to_bytes(k, "little") for v, k in ((CELL, 2), (folded, 2), (nx, 2), (ny, 2), (len(motion), 4), (len(rest), 4)))


def pack_predicted(rest: bytes, width: int, height: int, vectors: np.ndarray | None) -> bytes:
    """A predicted payload of generation 6: residual bytes, and a motion map unless ``vectors`` is None."""
    body = pack_blocks(rest, True)
    if vectors is None:
        return wrap(body)
    motion, folded = pack_motion_map(vectors)
    return wrap(_motion_head(-(-width // CELL), -(-height // CELL), folded, motion, body) + motion + body)


def encode(picture: bytes, width: int, height: int, previous: bytes | None = None, vectors: np.ndarray | None = None) -> bytes:
    """A lossless payload of generation 6: a key picture, or one predicted from ``previous`` with a vector per cell."""
    if previous is None:
        return wrap(pack_blocks(row_residual(picture, width, height)))
    vectors = None if vectors is None else np.asarray(vectors).reshape(-1, 2)
    moved = previous if vectors is None else moved_picture(previous, width, height, vectors)
    rest = ((np.frombuffer(picture, np.uint8).astype(int) - np.frombuffer(moved, np.uint8)) % 256).astype(np.uint8).tobytes()
    return pack_predicted(rest, width, height, vectors)
