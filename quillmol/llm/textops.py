"""Whole Arrow batches of UTF-8 text as byte arrays: words, hashes and windows without a loop over words."""

from __future__ import annotations

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words, odd."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix64(x) | np.uint64(1)


_TABLE = randoms(4096, 77)


def _coefficients(index: np.ndarray) -> np.ndarray:
    if len(index) and index.max() >= len(_TABLE):
        far = mix64(index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(991)) | np.uint64(1)
        return np.where(index < len(_TABLE), _TABLE[np.minimum(index, len(_TABLE) - 1)], far)
    return _TABLE[index]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string array; a null is empty."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def pieces(column, limit: int = 1 << 20):
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes, so that arrays stay small."""
    raw, offs = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def is_separator(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b | 32, b).astype(np.uint8)


def word_bounds(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+; none crosses rows."""
    n = len(b)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    word = ~is_separator(b)
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[offs[:-1]] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of the words' bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    index = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    inside = np.repeat(starts, lens) + index
    terms = (b[inside].astype(np.uint64) + np.uint64(1)) * _coefficients(index)
    return mix64(np.add.reduceat(terms, at) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, rows: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of k words that lie in one row, and the index of each one's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mult = randoms(k, 1000 * k + seed)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * mult[i]
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix64(total[first]), first


def shingle_sets(b: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, lower-cased in A-Z; with
    fewer words the whole sequence is one; without words the set is empty."""
    b = lower_ascii(b)
    starts, ends, rows = word_bounds(b, offs)
    words = word_hashes(b, starts, ends)
    hashes, first = window_hashes(words, rows, k)
    m = len(offs) - 1
    cut = np.searchsorted(rows[first] if len(first) else first, np.arange(m + 1))
    wcut = np.searchsorted(rows, np.arange(m + 1))
    out = []
    for i in range(m):
        w = wcut[i + 1] - wcut[i]
        if w >= k:
            h = np.sort(hashes[cut[i] : cut[i + 1]])
            if len(h) > 1:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
            out.append(h)
        elif w:
            own = words[wcut[i] : wcut[i + 1]]
            out.append(mix64(np.array([(own * randoms(k, 31)[: len(own)]).sum() + np.uint64(w)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
