"""Bytes of audio blocks: anchors, scales and codes, channel by channel within a frame."""

from __future__ import annotations

import numpy as np

from framelake.codecs.bits import Malformed

LIMITS = {8: (127, 128), 6: (31, 32)}


def pack_codes(codes: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return codes.astype(np.uint8).tobytes()
    flat = np.concatenate([codes, np.zeros(-len(codes) % 4, np.int64)]).reshape(-1, 4)
    value = (flat << np.array([0, 6, 12, 18])).sum(1)
    return np.stack([value & 255, value >> 8 & 255, value >> 16], 1).astype(np.uint8).tobytes()[: (len(codes) * 6 + 7) // 8]


def unpack_codes(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, np.uint8, n).astype(np.int64)
    part = np.frombuffer(data + bytes(-len(data) % 3), np.uint8).astype(np.int64).reshape(-1, 3)
    value = part[:, 0] | part[:, 1] << 8 | part[:, 2] << 16
    return ((value[:, None] >> np.array([0, 6, 12, 18])) & 63).ravel()[:n]


def record_bytes(channels: int, bits: int, frames: int) -> int:
    n = channels * frames
    return 4 * channels + (n if bits == 8 else (n * 6 + 7) // 8)


def encode_blocks(pcm: np.ndarray, bits: int = 8, block: int = 32, rounds: int = 4) -> bytes:
    """(frames, channels) samples of 16 bits as blocks; the last frame fills the last block."""
    limit, bias = LIMITS[bits]
    pcm = pcm.astype(np.int64)
    if not len(pcm):
        return b""
    pcm = np.concatenate([pcm, np.repeat(pcm[-1:], -len(pcm) % block, 0)]).reshape(-1, block, pcm.shape[1])
    anchor = pcm[:, 0]
    scale = np.maximum(1, -(-np.abs(np.diff(pcm, axis=1)).max(1, initial=0) // limit))
    for i in range(rounds):
        up = pcm - anchor[:, None]
        levels = np.sign(up) * ((np.abs(up) + scale[:, None] // 2) // scale[:, None])
        steps = np.diff(levels, axis=1, prepend=0)
        over = -(-np.abs(steps).max(1) // limit)
        if i == rounds - 1 or (over <= 1).all():
            break
        scale = scale * np.maximum(1, over)
    codes = np.clip(steps, -limit, limit) + bias
    stored = np.minimum(scale, 65535)
    return b"".join(a.astype("<i2").tobytes() + s.astype("<u2").tobytes() + pack_codes(c.ravel(), bits) for a, s, c in zip(anchor, stored, codes))


def decode_blocks(data: bytes, frames: int, channels: int, bits: int = 8, block: int = 32) -> np.ndarray:
    """(frames, channels) samples of the blocks."""
    if bits not in LIMITS or channels not in (1, 2) or not 8 <= block <= 1024:
        raise Malformed("bad audio parameters")
    size, n = record_bytes(channels, bits, block), -(-frames // block)
    if len(data) != size * n:
        raise Malformed("audio blocks don't fit their count")
    out = []
    for at in range(0, len(data), size):
        anchor = np.frombuffer(data, "<i2", channels, at).astype(np.int64)
        scale = np.frombuffer(data, "<u2", channels, at + 2 * channels).astype(np.int64)
        codes = unpack_codes(data[at + 4 * channels : at + size], block * channels, bits).reshape(block, channels) - LIMITS[bits][1]
        out.append(np.clip(anchor + np.cumsum(codes, axis=0) * scale, -32768, 32767))
    return np.concatenate([*out, np.zeros((0, channels), np.int64)]).astype(np.int16)[:frames]
