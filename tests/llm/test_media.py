import hashlib
import struct
import zlib

import numpy as np
import pytest

from shelfmark.llm import media


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (7, 64), (40, 3), (64, 64)])
def test_png_round_trip(shape):
    rng = np.random.default_rng(1)
    for pixels in (rng.integers(0, 256, shape), np.zeros(shape), np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 256):
        pixels = pixels.astype(np.uint8)
        assert (media.decode_png(media.encode_png(pixels)) == pixels).all()


def reference_filter(pixels, kinds):
    out = bytearray()
    for i, kind in enumerate(kinds):
        out.append(kind)
        for j in range(pixels.shape[1]):
            w = int(pixels[i, j - 1]) if j else 0
            n = int(pixels[i - 1, j]) if i else 0
            nw = int(pixels[i - 1, j - 1]) if i and j else 0
            p = w + n - nw
            near = min((abs(p - w), 0, w), (abs(p - n), 1, n), (abs(p - nw), 2, nw))[2]
            out.append((int(pixels[i, j]) - (0, w, n, (w + n) // 2, near)[kind]) & 255)
    return bytes(out)


def test_every_filter_is_undone():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (30, 11)).astype(np.uint8)
    kinds = rng.integers(0, 5, 30).tolist()
    kinds[:6] = [2, 2, 3, 4, 4, 1]
    raw = zlib.compress(reference_filter(pixels, kinds))
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">II", 11, 30) + media.GREY) + media._chunk(b"tEXt", b"a") + media._chunk(b"IDAT", raw[:9]) + media._chunk(b"IDAT", raw[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == pixels).all()


def test_damage_is_found():
    good = media.encode_png(np.arange(256, dtype=np.uint8).reshape(4, 64))
    for i in range(len(good)):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(good[:-5])


def test_hash_bears_small_changes():
    rng = np.random.default_rng(5)
    coarse = rng.integers(20, 236, (8, 8))
    smooth = np.kron(coarse, np.ones((12, 8))).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, smooth.shape).astype(np.uint8)
    bits = lambda p: int(media.cosine_hash(p), 16)
    assert (bits(smooth) ^ bits(noisy)).bit_count() <= 8 < (bits(smooth) ^ bits(other)).bit_count()


def test_rows(odd_docs):
    rows = media.encode_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = set()
    for r in odd_docs.collect():
        t = (r.text or "").encode()
        payload = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        want.add((r.doc_id, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    for r in rows:
        assert len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert media.decode_png(bytes(r.media)).tobytes()[: r.n_bytes] is not None and len(r.feature) == 16
    assert len({r.feature for r in rows if r.n_bytes == 0}) == 1


def test_empty(no_docs):
    assert media.encode_texts(no_docs).collect() == []


def overlap(n):
    """Shares of n rows in each of 32 equal spans."""
    edges = [n * k / 32 for k in range(33)]
    return np.array([[max(0.0, min(b, r + 1) - max(a, r)) / (n / 32) for r in range(n)] for a, b in zip(edges, edges[1:])])


@pytest.mark.parametrize("shape", [(1, 64), (5, 64), (32, 32), (100, 64), (47, 11)])
def test_hash_by_hand(shape, monkeypatch):
    rng = np.random.default_rng(sum(shape))
    pixels = rng.integers(0, 256, shape).astype(np.uint8)
    small = overlap(shape[0]) @ pixels.astype(float) @ overlap(shape[1]).T
    low = [round(sum(small[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = [low[0] > 32 * 32 * 127.5, *(x > middle for x in low[1:])]
    want = f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"
    assert media.cosine_hash(pixels) == want
    monkeypatch.setattr(media, "BLOCK", 100)
    assert media.cosine_hash(pixels) == want
    assert (media.decode_png(media.encode_png(pixels)) == pixels).all()
