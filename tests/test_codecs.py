import numpy as np
import pytest

from framelake.codecs import residual, sound, transform
from framelake.codecs.bits import BitReader, BitWriter, Bytes, Malformed, unzigzag, varint, zigzag

W, H = 36, 20


def picture(seed, w=W, h=H):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    luma = (x * 5 + y * 3 + rng.integers(0, 12, (h, w)) + 9 * seed) % 256
    return luma.astype(np.uint8).tobytes() + rng.integers(90, 120, w * h // 2).astype(np.uint8).tobytes()


def error(a, b):
    return np.abs(np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)).mean()


def test_bits():
    assert [varint(v) for v in (0, 127, 128, 1 << 28)] == [b"\0", b"\x7f", b"\x80\1", b"\x80\x80\x80\x80\1"]
    assert all(unzigzag(zigzag(v)) == v for v in range(-300, 300)) and [zigzag(v) for v in (0, -1, 1, -128)] == [0, 1, 2, 255]
    with pytest.raises(Malformed):
        Bytes(b"\x80" * 6).varint()
    w = BitWriter()
    w.zeros(3)
    w.put(5, 6)
    r = BitReader(w.bytes())
    assert r.zeros(7) == 3 and r.get(6) == 5


def test_impulse_and_constant_blocks():
    step = np.ones(64, int)
    block = np.zeros((1, 8, 8), int)
    block[0, 0, 0] = 1
    assert set(transform.levels_of(block, step)[0].tolist()) <= {1, -1}
    levels = transform.levels_of(np.full((1, 8, 8), 7), step)[0]
    assert levels[0] == 64 * 7 and not levels[1:].any()
    x = np.random.default_rng(1).integers(-255, 256, (50, 8, 8))
    assert (transform.residuals(transform.levels_of(x, step), step) == x).all()
    assert transform.block_count(1920, 1080) == 48_720


def test_hand_made_key_picture():
    # 8x8 luma, two 4x4 chroma planes; every block zero with predictor DC: all samples 128
    head = b"GTC7" + bytes([8, 78, 0, 0]) + (96).to_bytes(4, "little") + (3).to_bytes(4, "little")
    assert transform.decode_intra(head + bytes([0b01101101, 0b1]), 8, 8) == bytes([128]) * 96
    # luma coded: last place 0, run 0, level 2 (zig-zag 4): step 40 at quality 78, so 2 * 40 / 64 = 1.25, rounded 1
    out = transform.decode_intra(head + bytes([0b01101001, 0b1, 0, 0, 4]), 8, 8)
    assert out == bytes([129]) * 64 + bytes([128]) * 32
    for bad in (b"GTC8" + head[4:], head, head + bytes([0, 0]), head + bytes([0b01101101, 0b1, 9])):
        with pytest.raises(Malformed):
            transform.decode_intra(bad, 8, 8)


@pytest.mark.parametrize("quality", [60, 78, 97])
def test_transform_round_trips(quality):
    a, b = picture(1), picture(2)
    payload, seen = transform.encode_intra(a, W, H, quality)
    assert transform.decode_intra(payload, W, H) == seen and error(seen, a) < 12
    p7, seen7 = transform.encode_intra(b, W, H, quality, seen)
    assert transform.decode_intra(p7, W, H, seen) == seen7
    for bits in (True, False):
        p, moved = transform.encode_inter(b, W, H, quality, seen, bit_coded=bits)
        assert transform.decode_inter(p, W, H, seen) == moved and error(moved, b) < 12
        for n in range(0, len(p), 7):
            with pytest.raises(Malformed):
                transform.decode_inter(p[:n], W, H, seen)
        with pytest.raises(Malformed):
            transform.decode_inter(p, W, H, None)


def test_first_level_prediction_and_folding():
    seen = transform.encode_intra(picture(1), W, H, 78)[1]
    for quality in (40, 97):
        plain, moved = transform.encode_inter(picture(2), W, H, quality, seen, bit_coded=False)
        dc, again = transform.encode_inter(picture(2), W, H, quality, seen, dc_coded=True)
        assert again == moved and dc[:4] == b"GCP9"
        for payload in (dc, transform.folded(plain), b"GTP9" + plain[4:]):
            assert transform.decode_inter(payload, W, H, seen) == moved
            with pytest.raises(Malformed):
                transform.decode_inter(payload[:-1], W, H, seen)


def test_oldest_residual_forms():
    a, b = picture(1), picture(2)
    for runs in (False, True):
        for delta in (False, True):
            assert residual.unpack_grouped(residual.pack_grouped(a, runs, delta)) == a
    moved = residual.decode(residual.pack_grouped(bytes(len(a))), W, H, a, False, (3, -2))
    y, x = np.mgrid[0:H, 0:W]
    luma = np.frombuffer(a, np.uint8, W * H).reshape(H, W)
    assert moved[: W * H] == luma[np.clip(y + 2, 0, H - 1), np.clip(x - 3, 0, W - 1)].tobytes()
    rest = ((np.frombuffer(b, np.uint8).astype(int) - np.frombuffer(moved, np.uint8)) % 256).astype(np.uint8).tobytes()
    for payload in (residual.pack_grouped(rest, False), residual.pack_grouped(rest, True, True)):
        assert residual.decode(payload, W, H, a, False, (3, -2)) == b
    # by hand: one block of width 1 whose first and last codes are 1 (so -1)
    hand = b"GBP3" + bytes([64, 0, 0, 0, 64, 0, 0, 0, 1, 0, 0, 0, 1]) + bytes([1, 0, 0, 0, 0, 0, 0, 128])
    assert residual.unpack_grouped(hand) == bytes([255]) + bytes(62) + bytes([255])


def test_motion_is_followed():
    a = picture(1, 64, 64)
    luma = np.frombuffer(a, np.uint8, 64 * 64).reshape(64, 64)
    b = np.roll(luma, (-2, 4), (0, 1)).tobytes() + a[64 * 64 :]
    v = transform.choose_vectors(b, a, 64, 64)
    assert (v[1:-1, 1:-1] == [-4, 2]).all()


def test_residual_round_trips():
    a, b = picture(1), picture(2)
    assert residual.decode(residual.encode(a, W, H), W, H, None, True) == a
    assert residual.decode(residual.encode(b, W, H, a), W, H, a, False) == b
    v = [[2, -2], [-5, 3]]
    assert residual.decode(residual.encode(b, W, H, a, v), W, H, a, False) == b
    rng = np.random.default_rng(3)
    for scale in (0, 1, 3, 20, 255):
        data = (rng.integers(-scale, scale + 1, 64 * 300) % 256).astype(np.uint8).tobytes()[: 64 * 300 - 9]
        for delta in (False, True):
            assert residual.unpack_blocks(residual.pack_blocks(data, delta)) == data
    data = bytes(500) + b"abc" + bytes(2) + b"x" * 300 + bytes(131)
    assert residual.unwrap(residual.wrap(data)) == data and len(residual.wrap(data)) < 350 and residual.wrap(b"abc") == b"abc"
    # by hand: three zeros, then two literals
    assert residual.unwrap(b"ZP06" + (5).to_bytes(4, "little") + bytes([128, 1, 7, 9])) == bytes([0, 0, 0, 7, 9])
    whole = residual.pack_blocks(data)
    for n in range(len(whole)):
        with pytest.raises(Malformed):
            residual.unpack_blocks(whole[:n])


@pytest.mark.parametrize("bits,channels", [(8, 1), (8, 2), (6, 1), (6, 2)])
def test_audio(bits, channels):
    t = np.arange(1000)[:, None]
    pcm = (9000 * np.sin(t / 9 + np.arange(channels))).astype(np.int16)
    data = sound.encode_blocks(pcm, bits)
    assert len(data) == 32 * sound.record_bytes(channels, bits, 32)
    back = sound.decode_blocks(data, 1000, channels, bits)
    assert np.abs(back.astype(int) - pcm).mean() < (40 if bits == 8 else 150)
    codes = np.arange(64) % 64
    assert (sound.unpack_codes(sound.pack_codes(codes, 6), 64, 6) == codes).all()
    with pytest.raises(Malformed):
        sound.decode_blocks(data[:-1], 1000, channels, bits)
