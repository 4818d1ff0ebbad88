"""Transform pictures (generations 7, 8 and 9): 8x8 blocks over planar 4:2:0 samples.

A payload is parsed into levels of all blocks first; the inverse transform of a plane is then
one matrix product. Key pictures need the blocks above and to the left and are restored
block by block; predicted ones are restored a plane at a time.
"""

from __future__ import annotations

import numpy as np

from framelake.codecs.bits import BitReader, BitWriter, Bytes, Malformed, unzigzag, varint, zigzag
from framelake.functions.exprs import transform_steps
from framelake.operators.blocks import SCAN, sign_matrix

# Payload marks, by generation of predicted pictures; key pictures always have the first.
INTRA, INTER, INTER_BITS = b"GTC7", b"GTP8", b"GBP9"
INTER_PLAIN, INTER_DC, INTER_RUNS = b"GTP9", b"GCP9", b"GZP9"
CHUNK, LEVEL_BOUND, MOTION = 256, 1 << 20, 16

_signs = sign_matrix().astype(np.float64)
_scan = np.array(SCAN)


def planes(width: int, height: int) -> list[tuple[int, int]]:
    return [(width, height), (width // 2, height // 2), (width // 2, height // 2)]


def grid(width: int, height: int) -> tuple[int, int]:
    return -(-width // 8), -(-height // 8)


def block_count(width: int, height: int) -> int:
    return sum(nx * ny for nx, ny in (grid(*p) for p in planes(width, height)))


def steps(quality: int, plane: int) -> np.ndarray:
    return np.array(transform_steps(quality, plane > 0))


def div_round(v: np.ndarray, d) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + d // 2) // d)


def residuals(levels: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(n, 8, 8) residual samples of (n, 64) levels."""
    sums = ((levels * step).astype(np.float64) @ _signs).astype(np.int64)
    return div_round(sums, 64).reshape(-1, 8, 8)


def levels_of(blocks: np.ndarray, step: np.ndarray) -> np.ndarray:
    coeffs = (blocks.reshape(-1, 64).astype(np.float64) @ _signs.T).astype(np.int64)
    return div_round(coeffs, step)


def padded(plane: np.ndarray) -> np.ndarray:
    """A plane with its last row and column repeated up to whole blocks."""
    h, w = plane.shape
    return np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")


def as_blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def from_blocks(blocks: np.ndarray, nx: int, ny: int, w: int, h: int) -> np.ndarray:
    return blocks.reshape(ny, nx, 8, 8).swapaxes(1, 2).reshape(ny * 8, nx * 8)[:h, :w]


def split_planes(picture: bytes, width: int, height: int) -> list[np.ndarray]:
    out, at = [], 0
    for w, h in planes(width, height):
        out.append(np.frombuffer(picture, np.uint8, w * h, at).reshape(h, w).astype(np.int64))
        at += w * h
    return out


def joined(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.clip(p, 0, 255).astype(np.uint8).tobytes() for p in parts)


def median(a: int, b: int, c: int) -> int:
    return sorted((a, b, c))[1]


def _head(data: bytes, mark: bytes, size: int, expected: int, blocks: int) -> tuple[Bytes, int]:
    cursor = Bytes(data)
    if cursor.take(4) != mark:
        raise Malformed("unknown payload mark")
    unit, quality, third, fourth = cursor.take(4)
    if unit != size or fourth or not 1 <= quality <= 100 or (mark == INTRA and third):
        raise Malformed("bad payload head")
    if cursor.uint(4) != expected or cursor.uint(4) != blocks:
        raise Malformed("sizes don't fit the picture")
    return cursor, quality


def _fill(levels: np.ndarray, last: int, pairs) -> None:
    """Levels of one block from its (run, zig-zag level) pairs up to the last place."""
    at = 0
    while at <= last:
        run, z = pairs()
        if not 0 < z <= LEVEL_BOUND or run > last - at:
            raise Malformed("bad run or level")
        at += run
        levels[_scan[at]] = unzigzag(z)
        at += 1


def _tokens(levels: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Last place and (run, level) pairs of one block in scan order; -1 if all are zero."""
    places = np.flatnonzero(levels[_scan])
    if not len(places):
        return -1, []
    runs = np.diff(places, prepend=-1) - 1
    return int(places[-1]), list(zip(runs.tolist(), levels[_scan][places].tolist()))


# Key pictures, and predicted ones without motion ---------------------------------------

def decode_intra(data: bytes, width: int, height: int, previous: bytes | None = None) -> bytes:
    """The picture of a payload of generation 7; with ``previous``, one predicted from the same place."""
    expected = width * height * 3 // 2
    cursor, quality = _head(data, INTRA, 8, expected, block_count(width, height))
    n = block_count(width, height)
    described = BitReader(cursor.take((3 * n + 7) // 8))
    modes, zero = np.zeros(n, int), np.zeros(n, bool)
    for i in range(n):
        d = described.get(3)
        modes[i], zero[i] = d & 3, d >> 2
    if ((modes != 0) if previous is not None else (modes == 0)).any():
        raise Malformed("predictor that this kind of picture can't have")
    levels = np.zeros((n, 64), np.int64)
    for i in np.flatnonzero(~zero):
        last = cursor.u8()
        if last > 63:
            raise Malformed("last place past the block")
        _fill(levels[i], last, lambda: (cursor.varint(), cursor.varint()))
    cursor.done()
    old = split_planes(previous, width, height) if previous is not None else None
    out, at = [], 0
    for p, (w, h) in enumerate(planes(width, height)):
        nx, ny = grid(w, h)
        rest = residuals(levels[at : at + nx * ny], steps(quality, p))
        if old:
            out.append(np.clip(old[p] + from_blocks(rest, nx, ny, w, h), 0, 255))
        else:
            out.append(_restored(rest, modes[at : at + nx * ny], nx, ny, w, h))
        at += nx * ny
    return joined(out)


def _predicted(plane: np.ndarray, mode: int, x: int, y: int, bw: int, bh: int):
    """Prediction of the block at (x, y) from what stands above and to the left."""
    top = plane[y - 1, x : x + bw] if y else None
    left = plane[y : y + bh, x - 1] if x else None
    if mode == 1:
        edge = np.concatenate([e for e in (top, left) if e is not None] or [np.zeros(0, np.int64)])
        return (int(edge.sum()) + len(edge) // 2) // len(edge) if len(edge) else 128
    if mode == 2:
        return top[None, :] if top is not None else 128
    return left[:, None] if left is not None else 128


def _restored(rest: np.ndarray, modes: np.ndarray, nx: int, ny: int, w: int, h: int) -> np.ndarray:
    plane = np.zeros((h, w), np.int64)
    for i in range(nx * ny):
        x, y = i % nx * 8, i // nx * 8
        bw, bh = min(8, w - x), min(8, h - y)
        plane[y : y + bh, x : x + bw] = np.clip(_predicted(plane, modes[i], x, y, bw, bh) + rest[i, :bh, :bw], 0, 255)
    return plane


def encode_intra(picture: bytes, width: int, height: int, quality: int, previous: bytes | None = None) -> tuple[bytes, bytes]:
    """(payload, picture as it will be decoded): closed loop, the predictor of the fewest bytes, the first of equals."""
    n = block_count(width, height)
    described, body, out = BitWriter(), bytearray(), []
    old = split_planes(previous, width, height) if previous is not None else [None] * 3
    for p, plane in enumerate(split_planes(picture, width, height)):
        h, w = plane.shape
        step, back = steps(quality, p), np.zeros((h, w), np.int64)
        nx, ny = grid(w, h)
        for i in range(nx * ny):
            x, y = i % nx * 8, i // nx * 8
            bw, bh = min(8, w - x), min(8, h - y)
            best = None
            for mode in ([0] if previous is not None else [1, 2, 3]):
                guess = old[p][y : y + bh, x : x + bw] if mode == 0 else _predicted(back, mode, x, y, bw, bh)
                levels = levels_of(padded(plane[y : y + bh, x : x + bw] - guess), step)[0]
                last, tokens = _tokens(levels)
                code = b"" if last < 0 else bytes([last]) + b"".join(varint(r) + varint(zigzag(v)) for r, v in tokens)
                if best is None or len(code) < len(best[1]):
                    best = mode, code, guess, levels
            mode, code, guess, levels = best
            described.put(mode | (not code) << 2, 3)
            body += code
            back[y : y + bh, x : x + bw] = np.clip(guess + residuals(levels[None], step)[0, :bh, :bw], 0, 255)
        out.append(back)
    head = INTRA + bytes([8, quality, 0, 0]) + (width * height * 3 // 2).to_bytes(4, "little") + n.to_bytes(4, "little")
    return head + described.bytes() + bytes(body), joined(out)


# Predicted pictures with motion ------------------------------------------------------

def _neighbours(vectors: np.ndarray, x: int, y: int) -> list[int]:
    """Median of the vectors to the left, above and above right; missing ones are zero, or the one above."""
    zero = (0, 0)
    left = vectors[y, x - 1] if x else zero
    top = vectors[y - 1, x] if y else zero
    right = vectors[y - 1, x + 1] if y and x + 1 < vectors.shape[1] else top
    return [median(int(left[i]), int(top[i]), int(right[i])) for i in (0, 1)]


def _moved(old: list[np.ndarray], vectors: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """The planes of the picture before, each 16x16 luma block displaced by its vector; edges repeat."""
    out = []
    for p, (w, h) in enumerate(planes(width, height)):
        size = 8 if p else 16
        y, x = np.arange(h), np.arange(w)
        v = vectors[np.minimum(y // size, vectors.shape[0] - 1)][:, np.minimum(x // size, vectors.shape[1] - 1)]
        if p:
            v = np.sign(v) * (np.abs(v) // 2)
        out.append(old[p][np.clip(y[:, None] + v[..., 1], 0, h - 1), np.clip(x[None] + v[..., 0], 0, w - 1)])
    return out


def decode_inter(data: bytes, width: int, height: int, previous: bytes | None) -> bytes:
    """The picture of a predicted payload of generation 8 or 9."""
    if previous is None:
        raise Malformed("predicted picture without one before it")
    expected, n = width * height * 3 // 2, block_count(width, height)
    if data[:4] == INTER_RUNS:
        data = unfolded(data, expected)
    mark = data[:4]
    if mark not in (INTER, INTER_PLAIN, INTER_BITS, INTER_DC):
        raise Malformed("unknown payload mark")
    cursor, quality = _head(data, mark, MOTION, expected, n)
    nx, ny = -(-width // 16), -(-height // 16)
    if cursor.uint(4) != nx * ny:
        raise Malformed("vectors don't fit the picture")
    size = cursor.uint(4)
    motion = Bytes(data, cursor.at, cursor.at + size)
    cursor.take(size)
    vectors = np.zeros((ny, nx, 2), np.int64)
    for y in range(ny):
        for x in range(nx):
            kind = motion.u8()
            if kind > 1:
                raise Malformed("bad motion token")
            delta = [unzigzag(motion.varint()), unzigzag(motion.varint())] if kind else [0, 0]
            vector = [a + b for a, b in zip(_neighbours(vectors, x, y), delta)]
            if any(abs(v) > 12 or v % 2 for v in vector):
                raise Malformed("vector out of range")
            vectors[y, x] = vector
    motion.done()
    skipped = BitReader(cursor.take((n + 7) // 8))
    coded = [i for i in range(n) if not skipped.get(1)]
    levels = np.zeros((n, 64), np.int64)
    if mark == INTER_DC:
        _dc_blocks(cursor, levels, set(coded), width, height)
    elif mark != INTER_BITS:
        for i in coded:
            last = cursor.u8()
            if last > 63:
                raise Malformed("last place past the block")
            _fill(levels[i], last, lambda: _token(cursor))
    else:
        chunks = -(-n // CHUNK)
        if cursor.uint(4) != chunks:
            raise Malformed("bad chunk count")
        sizes = [cursor.uint(4) for _ in range(chunks)]
        readers = [BitReader(cursor.take(s)) for s in sizes]
        for i in coded:
            bits = readers[i // CHUNK]
            _fill(levels[i], bits.get(6), lambda bits=bits: _bit_pair(bits))
        if any(r.left > 7 or r.value for r in readers):
            raise Malformed("trailing bits")
    cursor.done()
    moved, out, at = _moved(split_planes(previous, width, height), vectors, width, height), [], 0
    for p, (w, h) in enumerate(planes(width, height)):
        bx, by = grid(w, h)
        out.append(moved[p] + from_blocks(residuals(levels[at : at + bx * by], steps(quality, p)), bx, by, w, h))
        at += bx * by
    return joined(out)


def unfolded(data: bytes, expected: int) -> bytes:
    """A payload whose repeated bytes were folded: runs of three or more, and literals."""
    cursor = Bytes(data, 4)
    size, out = cursor.uint(4), bytearray(INTER)
    if not 24 <= size <= expected * 4 + 65536:
        raise Malformed("bad unfolded size")
    while cursor.at < cursor.end:
        token = cursor.u8()
        out += cursor.take(1) * ((token & 127) + 3) if token > 127 else cursor.take(token + 1)
        if len(out) > size:
            raise Malformed("more than the size says")
    if len(out) != size:
        raise Malformed("less than the size says")
    return bytes(out)


def folded(payload: bytes) -> bytes:
    """A payload of generation 8 with its repeated bytes folded."""
    out, at, start = bytearray(), 4, 4

    def literals(end: int) -> None:
        for a in range(start, end, 128):
            part = payload[a : min(end, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(payload):
        end = at
        while end < len(payload) and payload[end] == payload[at] and end - at < 130:
            end += 1
        if end - at >= 3:
            literals(at)
            out.extend((128 | end - at - 3, payload[at]))
            start = end
        at = end
    literals(len(payload))
    return INTER_RUNS + len(payload).to_bytes(4, "little") + bytes(out)


def _dc_blocks(cursor: Bytes, levels: np.ndarray, coded: set[int], width: int, height: int) -> None:
    """Levels of blocks whose first one is told by its difference from the median of the
    blocks to the left, above, and above left."""
    at = 0
    for w, h in planes(width, height):
        nx, ny = grid(w, h)
        first = np.zeros((ny + 1, nx + 1), np.int64)
        for i in range(nx * ny):
            if at + i not in coded:
                continue
            x, y = i % nx, i // nx
            head = cursor.u8()
            last, kind = head & 63, head >> 6
            guess = median(int(first[y + 1, x]), int(first[y, x + 1]), int(first[y, x]))
            value = (0, guess, guess, guess)[kind]
            if kind == 2:
                value += cursor.u8() - 64
            elif kind == 3:
                value += unzigzag(cursor.varint())
            first[y + 1, x + 1] = levels[at + i, 0] = value
            place = 1
            while place <= last:
                run, z = _token(cursor)
                if not 0 < z <= LEVEL_BOUND or run > last - place:
                    raise Malformed("bad run or level")
                levels[at + i, _scan[place + run]] = unzigzag(z)
                place += run + 1
        at += nx * ny


def _token(cursor: Bytes) -> tuple[int, int]:
    token = cursor.u8()
    if token >= 128:
        return token >> 4 & 7, (token & 15) + 1
    if token:
        raise Malformed("reserved level token")
    return cursor.varint(), cursor.varint()


def _token_code(run: int, level: int) -> bytes:
    z = zigzag(level)
    return bytes([128 | run << 4 | z - 1]) if run < 8 and z <= 16 else b"\0" + varint(run) + varint(z)


def _bit_pair(bits: BitReader) -> tuple[int, int]:
    run = bits.zeros(7)
    run = bits.get(6) if run == 7 else run
    q = bits.zeros(31)
    return run, bits.get(32) if q == 31 else q << 2 | bits.get(2)


def _bit_code(writer: BitWriter, last: int, tokens: list[tuple[int, int]]) -> None:
    writer.put(last, 6)
    for run, level in tokens:
        z = zigzag(level)
        writer.zeros(min(run, 7))
        if run > 6:
            writer.put(run, 6)
        writer.zeros(min(z >> 2, 31))
        writer.put(*((z, 32) if z >> 2 > 30 else (z & 3, 2)))


def encode_inter(picture: bytes, width: int, height: int, quality: int, previous: bytes, vectors: np.ndarray | None = None, bit_coded: bool = True, dc_coded: bool = False) -> tuple[bytes, bytes]:
    """(payload, picture as it will be decoded) with the vectors given, or chosen by choose_vectors."""
    nx, ny, n = -(-width // 16), -(-height // 16), block_count(width, height)
    vectors = choose_vectors(picture, previous, width, height) if vectors is None else np.asarray(vectors, np.int64).reshape(ny, nx, 2)
    motion = bytearray()
    for y in range(ny):
        for x in range(nx):
            delta = [int(v) - p for v, p in zip(vectors[y, x], _neighbours(vectors, x, y))]
            motion += b"\1" + varint(zigzag(delta[0])) + varint(zigzag(delta[1])) if any(delta) else b"\0"
    moved = _moved(split_planes(previous, width, height), vectors, width, height)
    skipped, out, all_levels = BitWriter(), [], []
    for p, plane in enumerate(split_planes(picture, width, height)):
        h, w = plane.shape
        levels = levels_of(as_blocks(padded(plane - moved[p])), steps(quality, p))
        all_levels.append(levels)
        out.append(moved[p] + from_blocks(residuals(levels, steps(quality, p)), *grid(w, h), w, h))
    levels = np.concatenate(all_levels)
    coded = [_tokens(v) for v in levels]
    for last, _ in coded:
        skipped.put(last < 0, 1)
    body = bytearray()
    if dc_coded:
        bit_coded = False
        at = 0
        for w, h in planes(width, height):
            bx, by = grid(w, h)
            first = np.zeros((by + 1, bx + 1), np.int64)
            for i in range(bx * by):
                last, tokens = coded[at + i]
                if last < 0:
                    continue
                x, y = i % bx, i // bx
                value = int(levels[at + i, 0])
                delta = value - median(int(first[y + 1, x]), int(first[y, x + 1]), int(first[y, x]))
                first[y + 1, x + 1] = value
                kind = 0 if not value else 1 if not delta else 2 if -64 <= delta <= 63 else 3
                body.append(last | kind << 6)
                body += bytes([delta + 64]) if kind == 2 else varint(zigzag(delta)) if kind == 3 else b""
                for k, (run, level) in enumerate(tokens[1:] if value else tokens):
                    body += _token_code(run if value or k else run - 1, level)
            at += bx * by
    elif bit_coded:
        chunks = []
        for a in range(0, n, CHUNK):
            writer = BitWriter()
            for last, tokens in coded[a : a + CHUNK]:
                if last >= 0:
                    _bit_code(writer, last, tokens)
            chunks.append(writer.bytes())
        body += len(chunks).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") for c in chunks) + b"".join(chunks)
    else:
        for last, tokens in coded:
            if last >= 0:
                body.append(last)
                for run, level in tokens:
                    body += _token_code(run, level)
    reach = int(np.abs(vectors).max(initial=0))
    head = (INTER_DC if dc_coded else INTER_BITS if bit_coded else INTER) + bytes([MOTION, quality, reach, 0])
    head += b"".join(v.to_bytes(4, "little") for v in (width * height * 3 // 2, n, nx * ny, len(motion)))
    return head + bytes(motion) + skipped.bytes() + bytes(body), joined(out)


def choose_vectors(picture: bytes, previous: bytes, width: int, height: int, reach: int = 4) -> np.ndarray:
    """For each 16x16 block, the even displacement of least absolute difference; no motion among equals."""
    new, old = split_planes(picture, width, height)[0], split_planes(previous, width, height)[0]
    nx, ny = -(-width // 16), -(-height // 16)
    offsets = sorted(((dx, dy) for dy in range(-reach, reach + 1, 2) for dx in range(-reach, reach + 1, 2)), key=lambda v: (abs(v[0]) + abs(v[1]), v[1], v[0]))
    y, x = np.arange(height), np.arange(width)
    cell = (y // 16)[:, None] * nx + (x // 16)[None]
    costs = []
    for dx, dy in offsets:
        there = old[np.clip(y + dy, 0, height - 1)][:, np.clip(x + dx, 0, width - 1)]
        costs.append(np.bincount(cell.ravel(), np.abs(new - there).ravel(), nx * ny))
    return np.array(offsets, np.int64)[np.argmin(costs, axis=0)].reshape(ny, nx, 2)
