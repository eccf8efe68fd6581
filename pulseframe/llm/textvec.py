"""Words and word shingles of Arrow string batches as numpy arrays.

A batch is cut into pieces of 256 KB (a longer text is a piece of its own), whose
arrays take some 25 MB, so the working memory does not depend on the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
WORDS = 5  # words of a shingle

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                  0x165667B19E3779F9], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (three xor-shift multiplies)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def pieces(texts: pa.Array):
    """(first row, bytes, row offsets) of runs of texts of about PIECE_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE_BYTES, "right")) - 1)
        j = min(j, len(texts))
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True):
    """Start, end of every run of bytes other than 0x20 and 0x09-0x0D, its
    64-bit hash (A-Z lower-cased if ``fold``), and the first word of each row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    after = np.empty_like(white)
    after[-1], after[:-1] = True, white[1:]
    start = np.flatnonzero(~white & (before | edge[:-1]))
    end = np.flatnonzero(~white & (after | edge[1:])) + 1
    b = data.astype(np.uint64)
    if fold:
        b += ((data >= 65) & (data <= 90)).astype(np.uint64) * np.uint64(32)
    acc = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((b + np.uint64(1)) * powers(_BASE, len(data)), out=acc[1:])
    h = (acc[end] - acc[start]) * powers(_INVERSE, len(data))[start]
    h = mix(h ^ (end - start).astype(np.uint64))
    return start, end, h, np.searchsorted(start, offs)


def shingles(h: np.ndarray, first: np.ndarray, n: int = WORDS):
    """Hashes of all runs of ``n`` words (a row with fewer words: its whole
    sequence as one; without words none) and the first shingle of each row."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(made)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    row = np.repeat(np.arange(len(count)), made)
    w = first[row] + (np.arange(at[-1]) - at[row])
    size = np.minimum(count[row], n)
    out = size.astype(np.uint64)
    for k in range(n):
        live = size > k
        out = out * _BASE + np.where(live, mix(h[np.minimum(w + k, len(h) - 1)] + _STEP[k % 5]), 0)
    return mix(out), at


def shingle_sets(texts: pa.Array, n: int = WORDS):
    """(row, sorted distinct shingle hashes) of every text."""
    for i, data, offs in pieces(texts):
        _, _, h, first = words(data, offs)
        s, at = shingles(h, first, n)
        for k in range(len(at) - 1):
            yield i + k, np.unique(s[at[k]:at[k + 1]])
