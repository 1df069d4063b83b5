"""Vectorised byte kernels shared by the text operators.

A batch of texts is one byte array with document offsets.  Tokens are found
with comparisons on that array, and their 64-bit hashes come from prefix sums
of a polynomial in an odd base modulo 2**64, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

#: Bytes of the class [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        m = max(n, 2 * len(_POW))
        out = []
        for base in (_BASE, _INV):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW, _IPOW = out
    return _POW, _IPOW


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; salts give independent hashes."""
    x = x + U64((salt * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a newline, and their n + 1 offsets."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), offsets


def words(data: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside the class ``sep``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~sep[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs; equal runs have equal hashes."""
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def hashed_words(data: np.ndarray, sep: np.ndarray, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, in chunks that end with a separator.

    Working memory is that of one chunk, however long the text.
    """
    parts, at = [], 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and not sep[data[to - 1]]:
            more = np.flatnonzero(sep[data[to : to + size]])
            to = to + int(more[0]) + 1 if len(more) else min(to + size, len(data))
        part = data[at:to]
        s, e = words(part, sep)
        parts.append((s + at, e + at, word_hashes(part, s, e)))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of ``width`` words of each text.

    Returns all sets joined, each sorted, and n + 1 offsets.  A-Z are lower-cased;
    words are runs outside [\\x20\\x09-\\x0D].  A text of fewer words has its whole
    sequence as one shingle; one without words has the empty set.
    """
    data, offsets = join_texts(texts)
    data = LOWER[data]
    starts, _, h = hashed_words(data, BLANK)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h), np.uint64)
        for k in range(width):
            part = h[k:] if k else h
            acc[: len(part)] += mix(part, k + 1)
        acc = mix(acc, width + 1)
        out, sizes = [], np.zeros(len(texts) + 1, np.int64)
        for i in range(len(texts)):
            a, n = first[i], count[i]
            if n >= width:
                s = np.sort(acc[a : a + n - width + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            elif n:
                short = np.zeros(1, np.uint64)
                for k in range(n):
                    short += mix(h[a + k : a + k + 1], k + 1)
                s = mix(short, 1000 + int(n))
            else:
                s = h[:0]
            out.append(s)
            sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else h[:0]), np.cumsum(sizes)


def slices(batch, column: str, limit: int = 1_000_000):
    """Cuts an Arrow batch into pieces of about ``limit`` characters of text.

    Yields (piece, texts); a single text over the limit is a piece of its own, whole.
    """
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        to = min(to, at + 4000, batch.num_rows)
        piece = batch.slice(at, to - at)
        yield piece, texts.slice(at, to - at).to_pylist()
        at = to
