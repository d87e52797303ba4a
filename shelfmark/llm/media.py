"""Media columns: lossless PNG with checks, and low-frequency cosine hashes.

:func:`encode_png` writes 8-bit grey PNG: each row takes the filter among none, left and
up whose output is smallest, chosen for all rows at once. :func:`decode_png` tests the
signature, each chunk's CRC-32, the header and the length, and undoes the filters with
numpy. :func:`cosine_hash` shrinks an image to 32 x 32, takes the 8 x 8 lowest
frequencies of its cosine transform, and keeps one bit each against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.textkernel import buffers
from shelfmark.llm.shared import ship, tidy

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = b"\x08\x00\x00\x00\x00"
#: Pixels in a row of a payload's image, and the unit that payloads are filled to.
WIDTH = 64
SIDE, LOW = 32, 8
#: Rows of a batch that is given back, and bytes of pixels that are filtered at a time.
ROWS, BLOCK = 500, 1 << 18


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A (height, width) array of uint8 as grey PNG, height and width at least 1."""
    height, width = pixels.shape
    packer, parts = zlib.compressobj(level), []
    step = max(1, BLOCK // width)
    for a in range(0, height, step):
        own = pixels[a : a + step]
        left = own.copy()
        left[:, 1:] -= own[:, :-1]
        up = own.copy()
        up[1:] -= own[:-1]
        if a:
            up[0] -= pixels[a - 1]
        forms = np.stack([own, left, up])
        cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
        chosen = cost.argmin(axis=0)
        lines = np.empty((len(own), width + 1), np.uint8)
        lines[:, 0] = chosen
        lines[:, 1:] = forms[chosen, np.arange(len(own))]
        parts.append(packer.compress(lines.tobytes()))
    parts.append(packer.flush())
    head = struct.pack(">II", width, height) + GREY
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(parts)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey PNG; ValueError says which test it fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended, data = 8, None, [], False, memoryview(data)
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = bytes(data[at + 4 : at + 8]), data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">II", body[:8])
            if body[8:] != GREY:
                raise ValueError("only 8-bit grey without interlace is read")
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height = head
    out = np.empty((height, width), np.uint8)
    unpacker, rest, row = zlib.decompressobj(), b"", 0
    above = np.zeros(width, np.uint8)
    short = "pixel data has another length than the header says"
    for part in (body[k : k + BLOCK // 4] for body in parts for k in range(0, len(body), BLOCK // 4)):
        rest += unpacker.decompress(part)
        n = len(rest) // (width + 1)
        if row + n > height:
            raise ValueError(short)
        if n:
            lines = np.frombuffer(rest, np.uint8, n * (width + 1)).reshape(n, width + 1)
            out[row : row + n] = _unfilter(lines[:, 0], lines[:, 1:].copy(), above)
            above, row, rest = out[row + n - 1], row + n, rest[n * (width + 1) :]
    if row != height or rest or unpacker.flush() or not unpacker.eof:
        raise ValueError(short)
    return out


def _unfilter(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo the filters of rows below `above`: left in all such rows at once, up by running sums over
    each run of rows, average and Paeth, which need each pixel before the next, pixel by pixel."""
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    left = kinds == 1
    if left.any():
        rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    if not (kinds >= 2).any():
        return rows
    edges = np.flatnonzero(np.diff(kinds) != 0) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)]):
        if kinds[a] == 2:
            rows[a] += rows[a - 1] if a else above
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
        elif kinds[a] >= 3:
            for i in range(a, b):
                over = (rows[i - 1] if i else above).astype(int)
                line, w, nw = rows[i], 0, 0
                for j, n in enumerate(over.tolist()):
                    if kinds[i] == 3:
                        guess = (w + n) >> 1
                    else:
                        p = w + n - nw
                        d = abs(p - w), abs(p - n), abs(p - nw)
                        guess = w if d[0] <= d[1] and d[0] <= d[2] else n if d[1] <= d[2] else nw
                    line[j] = w = (int(line[j]) + guess) & 255
                    nw = n
    return rows


_k = np.arange(LOW)[:, None]
_COSINES = np.cos(np.pi * _k * (2 * np.arange(SIDE)[None] + 1) / (2 * SIDE))


def _shrink(a: np.ndarray) -> np.ndarray:
    """Mean of the rows over SIDE equal spans, with parts of rows where spans end within."""
    n = len(a)
    at = np.arange(SIDE + 1) * (n / SIDE)
    low = np.minimum(at.astype(int), n - 1)
    edge, total = np.empty((SIDE + 1, *a.shape[1:])), np.zeros(a.shape[1:])
    step = max(1, BLOCK // max(1, a.shape[1]))
    for k in range(0, n, step):
        own = a[k : k + step].astype(np.float64)
        upto = np.concatenate([total[None], total + np.cumsum(own, axis=0)])
        here = np.flatnonzero((low >= k) & (low < k + len(own)))
        edge[here] = upto[low[here] - k] + (at[here] - low[here])[:, None] * own[low[here] - k]
        total = upto[-1]
    return np.diff(edge, axis=0) / (n / SIDE)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: low frequencies above their median, the constant part aside."""
    small = _shrink(_shrink(pixels).T).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = low[0] > SIDE * SIDE * 127.5
    return np.packbits(bits).tobytes().hex()


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = True) -> DataFrame:
    """One row per row of `docs`: its text as a PNG column, read back, with digests and hash.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, with `media`, media (binary). A payload is the text's UTF-8
    with zero bytes up to a positive multiple of 64; everything after that is computed
    from the decoded file. Null texts count as empty. Equal texts give equal values. No
    shuffle; a worker holds one image at a time besides its batch. An empty table gives no
    rows; rows that repeat a key are rows of their own; other columns play no part.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    fields = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media

    def run(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            data, offsets = buffers(batch.column(1))
            out: list[list] = [[] for _ in range(8)]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                size = max(-(-(b - a) // WIDTH), 1) * WIDTH
                payload = np.zeros(size, np.uint8)
                payload[: b - a] = data[a:b]
                stored = encode_png(payload.reshape(-1, WIDTH))
                pixels = decode_png(stored)
                values = (b - a, pixels.size, hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-1]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(pixels), stored if media else None)
                for column, value in zip(out, values):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(columns[: 8 + media], names[: 8 + media])

    return docs.select(key, text).mapInArrow(tidy(run), fields)
