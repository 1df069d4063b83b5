"""PNG images in binary columns: a reader, a writer and a perceptual hash.

Everything is built from zlib chunks: signature, IHDR, IDAT and IEND with their
CRC-32 tests, scan-line filters undone with numpy, and a hash of the low frequencies
of the two-dimensional cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernels as K

#: Fixed values of the PNG format: signature, channels and bit depths by color type, and
#: the seven interlacing passes (first row, first column, row step, column step).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
#: Images of more bytes of samples than this are not inflated.
MAX_BYTES = 1 << 30
WIDTH = 64
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A PNG of 8-bit samples (height, width) or (height, width, channels).

    The image takes the one of the filters None, Sub and Up with the least sum of
    absolute differences.
    """
    h, w = samples.shape[:2]
    bpp = 1 if samples.ndim == 2 else samples.shape[2]
    color = {1: 0, 3: 2, 2: 4, 4: 6}[bpp]
    rows = samples.reshape(h, w * bpp)
    sub, up = rows.copy(), rows.copy()
    sub[:, bpp:] -= rows[:, :-bpp]
    up[1:] -= rows[:-1]
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum(dtype=np.int64) for x in (rows, sub, up)]))
    lines = np.empty((h, w * bpp + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = (rows, sub, up)[kind]
    head = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Samples of a PNG (height, width) or (height, width, channels).

    Samples of up to 8 bits are uint8, those of 16 bits uint16, both as stored; palette
    images give their colors.  Interlaced images are put in order.  ValueError if
    anything is wrong, or if the image would take more than ``max_bytes``; no more than
    the announced size is ever inflated.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, palette, body, ended = 8, None, None, [], False
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        check = data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError("bad checksum")
        at += 12 + size
        if kind == b"IHDR":
            if head is not None or len(part) != 13:
                raise ValueError("bad header")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            if not part or len(part) % 3 or len(part) > 768:
                raise ValueError("bad palette")
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
    if head is None or not ended:
        raise ValueError("chunks missing")
    w, h, depth, color, method, filtering, lace = head
    if not w or not h:
        raise ValueError("empty image")
    if depth not in DEPTHS.get(color, ()) or method or filtering or lace > 1:
        raise ValueError("unsupported image")
    if color == 3 and palette is None:
        raise ValueError("no palette")
    bits = depth * CHANNELS[color]
    passes = [(y, x, dy, dx, -(-(h - y) // dy), -(-(w - x) // dx)) for y, x, dy, dx in (PASSES if lace else [(0, 0, 1, 1)]) if y < h and x < w]
    need = sum(n * (-(-m * bits // 8) + 1) for *_, n, m in passes)
    body = b"".join(body)
    if max(need, h * w * CHANNELS[color] * (2 if depth == 16 else 1)) > max_bytes:
        raise ValueError("too large")
    if need > 1040 * (len(body) + 16):  # beyond what deflate can pack
        raise ValueError("wrong size")
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(body, need + 1)
    except zlib.error as e:
        raise ValueError("bad data") from e
    if len(raw) != need or not stream.eof:
        raise ValueError("wrong size")
    out, at = np.empty((h, w, CHANNELS[color]), np.uint16 if depth == 16 else np.uint8), 0
    for y, x, dy, dx, n, m in passes:
        width = -(-m * bits // 8)
        lines = np.frombuffer(raw, np.uint8, n * (width + 1), at).reshape(n, width + 1)
        at += n * (width + 1)
        step = max(1, bits // 8)
        rows = _unfilter(lines[:, 0], lines[:, 1:].reshape(n, width // step, step)).reshape(n, width)
        out[y::dy, x::dx] = _samples(rows, m, depth, CHANNELS[color])
    if color == 3:
        if int(out.max()) >= len(palette):
            raise ValueError("bad palette index")
        return palette[out[:, :, 0]]
    return out[:, :, 0] if CHANNELS[color] == 1 else out


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Samples (rows, width, channels) from the bytes of unfiltered lines."""
    if depth == 16:
        rows = np.ascontiguousarray(rows).view(">u2")
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
    return rows.reshape(len(rows), width, channels)


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Undoes scan-line filters; runs of None, Sub and Up in whole-array steps.

    Runs of Average and Paeth go by diagonals: a pixel needs those left, above and above
    left, so all pixels of a diagonal are found at once.
    """
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    out = np.empty_like(x)
    h = len(x)
    group = np.minimum(kinds, 3)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), h] if h else [0]
    zero = np.zeros(x.shape[1:], np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind, above = int(group[a]), out[a - 1] if a else zero
        if kind == 0:
            out[a:b] = x[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(x[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], x[a:b]]), axis=0, dtype=np.uint8)[1:]
        else:
            out[a:b] = _diagonals(kinds[a:b] == 3, x[a:b], above)
    return out


def _diagonals(average: np.ndarray, x: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Lines of the filters Average (where told) and Paeth, below the line ``above``."""
    n, w, step = x.shape
    # One line and one column more, for what lies outside.
    full = np.zeros((n + 1, w + 1, step), np.int16)
    full[0, 1:] = above
    for d in range(n + w - 1):
        row = np.arange(max(0, d - w + 1), min(n, d + 1))
        col = d - row
        left, up, corner = full[row + 1, col], full[row, col + 1], full[row, col]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        full[row + 1, col + 1] = (x[row, col] + np.where(average[row, None], (left + up) >> 1, paeth)) & 255
    return full[1:, 1:].astype(np.uint8)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(k)[:, None] / (2 * n))


_COS = _cosines(SIDE, LOW)


def dct_hash(samples: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest frequencies exceed their median."""
    gray = samples.astype(np.float64) if samples.ndim == 2 else samples[..., :3].mean(-1)
    for axis in (0, 1):
        n = gray.shape[axis]
        at = np.arange(SIDE + 1) * n // SIDE
        total = np.concatenate([np.zeros_like(np.take(gray, [0], axis)), np.cumsum(gray, axis)], axis)
        hi = np.maximum(at[1:], at[:-1] + 1)
        lo = np.minimum(at[:-1], n - 1)
        hi = np.minimum(np.maximum(hi, lo + 1), n)
        part = np.take(total, hi, axis) - np.take(total, lo, axis)
        gray = part / (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
    low = np.round(_COS @ gray @ _COS.T, 6)
    bits = (low > np.median(low.reshape(-1)[1:])).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def text_payload(text: str | None) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _store(level: int):
    def run(batches):
        for batch in batches:
            for piece, texts in K.slices(batch, "text"):
                sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                media = [encode_png(np.frombuffer(text_payload(t), np.uint8).reshape(-1, WIDTH), level) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return run


def text_to_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """(id, n_bytes, media): every text as a gray PNG of 64 samples a row.

    Null and empty texts give one row of zeros; repeated rows and null ids each give
    their row; an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store(level), "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def image_features(data: bytes | None, max_bytes: int = MAX_BYTES) -> tuple:
    """_FEATURES of one stored image; the last is what is wrong with it, if anything."""
    if data is None:
        return None, None, None, None, None, None, "null"
    stored = len(data), hashlib.sha256(data).hexdigest()
    try:
        x = decode_png(data, max_bytes)
    except ValueError as e:
        return None, None, None, *stored, None, str(e)
    payload = np.ascontiguousarray(x, x.dtype.newbyteorder(">")).tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, dct_hash(x), None


def _read(max_bytes: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows = [image_features(data.as_py(), max_bytes) for data in piece.column(2)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *cols], ["id", "n_bytes", *_FEATURES])

    return run


_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]


def png_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Reads stored PNGs back: payload digests, the cosine hash, or the error.

    The payload is the samples in rows, those of 16 bits with the high byte first.  Null,
    empty, damaged and unsupported images, and those of more than ``max_bytes`` of
    samples, give null features and say why in ``error``; the batch goes on.
    ``n_bytes`` passes through.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), "n_bytes", F.col(media_col).alias("media"))
    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return rows.mapInArrow(_read(max_bytes), kinds).withColumnRenamed("id", id_col)
