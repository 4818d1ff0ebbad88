"""Motion on whole pictures: candidates, scores, global and block estimates, rate and distortion.

Candidates are tried in a fixed order and a later one must be better, so the first of equals wins. All blocks
of a picture are scored at once, candidate by candidate.
"""

from __future__ import annotations

import numpy as np

from framelake.codecs import transform as T
from framelake.functions import exprs as E

# Samples of a scene score and of a block score, the cell of a motion map, its acceptance.
SCENE_STRIDE, CELL, PENALTY, LEAST_GAIN, GAIN_PERCENT = 16, 32, 24, 384, 72


def at_quality(quality: int, table) -> float:
    steps, last = table
    return next((v for least, v in steps if quality >= least), last)


def luma(picture: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(picture, np.uint8, width * height).reshape(height, width).astype(np.int64)


def scene_samples(picture: bytes, width: int, height: int) -> np.ndarray:
    return luma(picture, width, height)[::SCENE_STRIDE, ::SCENE_STRIDE]


def scene_score(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a - b).mean())


def cross(reach: int, hint: tuple[int, int] = (0, 0), most: int = 32) -> list[tuple[int, int]]:
    """Even displacements to try: none, a cross around the hint, and the corners next to none; the first of equals is kept."""
    tried = [(0, 0)]
    for d in range(2, reach + 1, 2):
        tried += [(hint[0] + d, hint[1]), (hint[0] - d, hint[1]), (hint[0], hint[1] + d), (hint[0], hint[1] - d)]
    tried += [(x, y) for x in (2, -2) for y in (2, -2)] if reach >= 2 else []
    even = lambda v: (v := min(max(v, -reach), reach)) - (v & 1)
    return list(dict.fromkeys((even(x), even(y)) for x, y in tried))[:most]


# One vector for the picture ------------------------------------------------------------

def _first_best(scores: dict, tried: list) -> tuple[float, tuple[int, int]]:
    """The first of the least scores of the displacements tried, in order."""
    best = min(range(len(tried)), key=lambda i: (scores[tried[i]], i))
    return scores[tried[best]], tried[best]


def _square(centre: tuple[int, int], radius: int, reach: int, clamped: bool = False) -> list[tuple[int, int]]:
    cells = [(centre[0] + x, centre[1] + y) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]
    if clamped:
        return list(dict.fromkeys((min(max(x, -reach), reach), min(max(y, -reach), reach)) for x, y in cells))
    return [(x, y) for x, y in cells if abs(x) <= reach and abs(y) <= reach]


def global_motion(new: np.ndarray, old: np.ndarray, reach: int, form: str = "guarded", quality: int = 78, hint: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """One displacement (dx, dy) of a luma plane: new(x, y) is like old(x - dx, y - dy), judged on a grid of samples.

    ``plain``: a coarse grid, then the places next to its best. ``guarded``: no motion must be beaten, and stands
    where it is nearly perfect. ``hinted``: around the hint and around none first; if that is good enough, no more.
    """
    h, w = new.shape
    reach = min(max(reach, 0), 31)
    if not reach or w < 64 or h < 64:
        return 0, 0
    step, margin = 10 if form == "plain" else min(max(h // 54, 10), 24), reach + 2
    y, x = np.arange(margin, h - margin, step), np.arange(margin, w - margin, step)
    if form != "hinted" and min(len(x), len(y)) < 4:
        return 0, 0

    class Scores(dict):
        def __missing__(self, v):
            self[v] = float(np.abs(new[np.ix_(y, x)] - old[np.ix_(y - v[1], x - v[0])]).mean()) if len(x) and len(y) else 1e30
            return self[v]

    scores, zero = Scores(), (0, 0)
    coarse = lambda inc: [(dx, dy) for dy in range(-reach, reach + 1, inc) for dx in range(-reach, reach + 1, inc)]
    if form == "plain":
        tried = coarse(2 if reach >= 2 else 1)
    elif scores[zero] <= 0.5:
        return zero
    elif form == "guarded":
        tried = [zero, *coarse(2 if reach >= 2 else 1)]
    else:
        near = _square((min(max(hint[0], -reach), reach), min(max(hint[1], -reach), reach)), 2, reach, True)
        tried = [zero, *dict.fromkeys(near + _square(zero, 1, reach, True))]
        best, v = _first_best(scores, tried)
        if best <= 4 or best <= scores[zero] * 0.9:
            return v
        tried = tried + coarse(min(2 if quality >= 86 else 4, reach))
    _, v = _first_best(scores, tried)
    return _first_best(scores, [v, *_square(v, 1, reach)])[1]


def shifted(picture: bytes, width: int, height: int, v: tuple[int, int]) -> bytes:
    """The picture displaced by one vector, chroma by half of it toward zero; edges repeat."""
    out = []
    for p, plane in enumerate(T.split_planes(picture, width, height)):
        h, w = plane.shape
        dx, dy = (int(c / 2) for c in v) if p else v
        out.append(plane[np.clip(np.arange(h) - dy, 0, h - 1)][:, np.clip(np.arange(w) - dx, 0, w - 1)])
    return T.joined(out)


# One vector for each cell of 32 ----------------------------------------------------------

def block_motion(new: np.ndarray, old: np.ndarray, reach: int, quality: int = 78) -> np.ndarray:
    """(cells, 2) displacements of the 32x32 cells of a luma plane; none where it is not much better than none."""
    h, w = new.shape
    nx, ny = -(-w // CELL), -(-h // CELL)
    found = np.zeros((nx * ny, 2), np.int64)
    reach = min(max(reach, 0), 15)
    if not reach:
        return found
    stride = 4 if quality >= 86 else 8
    y, x = (v.ravel() for v in np.meshgrid(np.arange(0, h, stride), np.arange(0, w, stride), indexing="ij"))
    cell = y // CELL * nx + x // CELL
    n = np.bincount(cell, minlength=nx * ny)

    def score(v: np.ndarray) -> np.ndarray:
        there = old[np.clip(y - v[cell, 1], 0, h - 1), np.clip(x - v[cell, 0], 0, w - 1)]
        return np.bincount(cell, np.abs(new[y, x] - there), nx * ny).astype(np.int64) * 256 // np.maximum(n, 1)

    zero = score(found)
    best, inc = zero.copy(), 1 if reach <= 2 else 2

    def attempt(v: np.ndarray, allowed: np.ndarray) -> None:
        cost = score(v) + PENALTY * np.abs(v).sum(1)
        better = allowed & (cost < best)
        best[better], found[better] = cost[better], v[better]

    moving = zero > 256
    for dy in range(-reach, reach + 1, inc):
        for dx in range(-reach, reach + 1, inc):
            if dx or dy:
                attempt(np.tile([dx, dy], (nx * ny, 1)), moving)
    if inc > 1:
        centre = found.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v = centre + [dx, dy]
                attempt(v, moving & (np.abs(v) <= reach).all(1))
    found[~((best + LEAST_GAIN < zero) & (best * 100 < zero * GAIN_PERCENT))] = 0
    return found


# One vector for each macroblock of 16 -----------------------------------------------------

def zigzag_size(v: np.ndarray) -> np.ndarray:
    """Bytes of signed numbers as zig-zag varints."""
    return varint_size(np.where(v < 0, -2 * v - 1, 2 * v))


def varint_size(z: np.ndarray) -> np.ndarray:
    return 1 + sum((z >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))


def vector_rate(v: np.ndarray) -> np.ndarray:
    """Bytes of vectors (n, 2) against none."""
    return np.where((v == 0).all(1), 1, 1 + zigzag_size(v).sum(1))


def level_sizes(levels: np.ndarray, tokens: bool = True) -> np.ndarray:
    """Bytes of blocks (n, 64) of levels: a last place, then runs and levels, as short tokens where ``tokens`` allows; 0 for an empty block."""
    scan = levels[:, T.SCAN]
    row, place = np.nonzero(scan)
    first = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    run = np.where(first, place, place - np.concatenate(([0], place[:-1]))[: len(row)] - 1)
    v = scan[row, place]
    z = np.where(v < 0, -2 * v - 1, 2 * v)
    long = varint_size(run) + varint_size(z)
    each = np.where((run < 8) & (z <= 16), 1, 1 + long) if tokens else long
    sizes = np.bincount(row, each, len(levels)).astype(np.int64)
    return sizes + (sizes > 0)


def sampled_differences(new: np.ndarray, old: np.ndarray, vectors: list[tuple[int, int]], size: int = 16, stride: int = 2) -> np.ndarray:
    """(candidates, blocks) sums of absolute differences on every ``stride``-th sample; new(x, y) is like old(x + dx, y + dy)."""
    h, w = new.shape
    nx, ny = -(-w // size), -(-h // size)
    y, x = np.arange(0, h, stride), np.arange(0, w, stride)
    cell = (y // size)[:, None] * nx + (x // size)[None]
    out = []
    for dx, dy in vectors:
        there = old[np.clip(y + dy, 0, h - 1)][:, np.clip(x + dx, 0, w - 1)]
        out.append(np.bincount(cell.ravel(), np.abs(new[::stride, ::stride] - there).ravel(), nx * ny))
    return np.array(out, np.int64)


def shortlist(differences: np.ndarray, finalists: int) -> np.ndarray:
    """(finalists + 1, blocks) places of the candidates to look at closely: the first one (no motion), then those of the least difference."""
    order = np.argsort(differences[1:], axis=0, kind="stable")[:finalists] + 1
    return np.concatenate([np.zeros((1, differences.shape[1]), np.int64), order])


def plane_costs(new: np.ndarray, moved: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, squared error) of each 8x8 block of a plane that is predicted by another."""
    h, w = new.shape
    nx, ny = T.grid(w, h)
    levels = T.levels_of(T.as_blocks(T.padded(new - moved)), step)
    back = np.clip(moved + T.from_blocks(T.residuals(levels, step), nx, ny, w, h), 0, 255)
    error = np.pad((new - back) ** 2, ((0, -h % 8), (0, -w % 8)))
    return level_sizes(levels), error.reshape(ny, 8, nx, 8).sum((1, 3)).ravel()


def macroblock_costs(picture: list[np.ndarray], before: list[np.ndarray], vectors: np.ndarray, quality: int) -> np.ndarray:
    """Distortion and bytes together of each macroblock, all planes, with a vector (ny, nx, 2) for each."""
    h, w = picture[0].shape
    ny, nx = vectors.shape[:2]
    moved = T._moved(before, vectors, w, h)
    cost = vector_rate(vectors.reshape(-1, 2)).reshape(ny, nx).astype(np.int64)
    for p, plane in enumerate(picture):
        size, error = plane_costs(plane, moved[p], T.steps(quality, p))
        bx, by = T.grid(plane.shape[1], plane.shape[0])
        y, x = np.divmod(np.arange(bx * by), bx)
        np.add.at(cost, (y if p else y // 2, x if p else x // 2), size + error)
    return cost.ravel()


def search_vectors(picture: bytes, previous: bytes, width: int, height: int, quality: int, reach: int = 4, finalists: int = 1) -> np.ndarray:
    """(ny, nx, 2): for each macroblock the candidate of least distortion and rate of a shortlist, the first of equals."""
    new, old = (T.split_planes(x, width, height) for x in (picture, previous))
    nx, ny = -(-width // 16), -(-height // 16)
    reach = min(max(reach, 0), 12) // 2 * 2
    tried = cross(reach)
    chosen = shortlist(sampled_differences(new[0], old[0], tried), min(max(finalists, 0), 7))
    vectors = np.array(tried, np.int64)[chosen].reshape(len(chosen), ny, nx, 2)
    costs = np.array([macroblock_costs(new, old, v, quality) for v in vectors])
    best = costs.argmin(0)
    return vectors.reshape(len(chosen), ny * nx, 2)[best, np.arange(ny * nx)].reshape(ny, nx, 2)


def quantized_picture(picture: bytes, width: int, height: int, quality: int) -> bytes:
    """Samples to the nearest multiple of the quality's step, at most 255."""
    out = []
    for p, plane in enumerate(T.split_planes(picture, width, height)):
        step = at_quality(quality, E.CHROMA_STEPS if p else E.LUMA_STEPS)
        out.append(np.minimum((plane + step // 2) // step * step, 255))
    return T.joined(out)


def quantized_difference(new: bytes, moved: bytes, dead: int, step: int) -> bytes:
    """Differences of bytes modulo 256, none within the dead zone, else the nearest multiple of the step."""
    d = (np.frombuffer(new, np.uint8).astype(np.int64) - np.frombuffer(moved, np.uint8) + 128) % 256 - 128
    size = np.minimum((np.abs(d) + step // 2) // step * step, 127) if step > 1 else np.abs(d)
    return (np.where(np.abs(d) <= dead, 0, np.sign(d) * size) % 256).astype(np.uint8).tobytes()
