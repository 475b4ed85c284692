"""Words, word hashes and word shingles of whole batches of texts, as numpy columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  All functions
work on a slice of a batch of at most about two million bytes, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(U, copy=True)
    x += U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


PLACE = mix(np.arange(1000, 1016, dtype=U)) | U(1)
SEED = U(0x2545F4914F6CDD1D)
#: The bytes of a lane that belong to a word with so many left.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Words of more bytes are hashed one at a time.
LONG = 512


def slices(texts: pa.Array, limit: int = 2_000_000):
    """(first row, bytes, offsets) of consecutive rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray):
    """Start, end and row of every word, and the words of each row."""
    solid = np.r_[~SPACE[raw], False]
    first = np.zeros(len(solid), bool)
    first[offs[:-1]] = True
    before = np.r_[False, solid[:-1]]
    start = np.flatnonzero(solid & (~before | first))
    after = np.r_[solid[1:], False]
    last = np.zeros(len(solid) + 1, bool)
    last[offs[1:]] = True
    end = np.flatnonzero(solid & (~after | last[1:])) + 1
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row, np.bincount(row, minlength=len(offs) - 1)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, letters A-Z read as a-z.

    Spans are read in lanes of eight bytes, all spans at once, and the hash is scrambled after each lane, so no
    two patterns of letters cancel out.  Equal lengths of at most eight bytes never collide.
    """
    low = np.r_[LOWER[raw], np.zeros(8, np.uint8)]
    lanes = np.ndarray((len(raw) + 1,), "<u8", low, strides=(1,))
    size = end - start
    out = mix(size.astype(U) ^ SEED)
    left, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(left):
        rest = size[left] - done
        out[left] = mix(out[left] ^ (lanes[start[left] + done] & KEEP[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes(), int(SEED))
    return out


def shingles(w: np.ndarray, row: np.ndarray, count: np.ndarray, k: int = 5):
    """(row, hash) of every run of k words; a row of fewer words gives its whole sequence."""
    n = len(w)
    if n >= k:
        at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        g = np.zeros(len(at), U)
        for j in range(k):
            g += w[at + j] * PLACE[j]
        rows, g = row[at], mix(g)
    else:
        rows, g = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.r_[0, np.cumsum(count)]
        extra = np.array([np.sum(w[first[r] : first[r + 1]] * PLACE[: count[r]], dtype=U) for r in short], U)
        extra += count[short].astype(U) * PLACE[14]
        rows, g = np.r_[rows, short], np.r_[g, mix(extra)]
    return rows, g


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int = 5):
    """Distinct shingles in order of row and hash: (row, hash, set size of each row)."""
    start, end, row, count = words(raw, offs)
    rows, g = shingles(span_hashes(raw, start, end), row, count, k)
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])][: len(rows)]
    rows, g = rows[new], g[new]
    return rows, g, np.bincount(rows, minlength=len(offs) - 1)
