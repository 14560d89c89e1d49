"""Words and their hashes for whole Arrow batches at once.

A word is a run of ASCII letters and digits and of characters beyond ASCII; ASCII case is folded.
The scan works on the UTF-8 bytes of all rows of a batch together, so it has no loop over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wirelake.llm.common import chunks_of_rows

_U64 = np.uint64
_BYTE = np.arange(256)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(_U64) + _U64(1)
_PLACES = 4096
_WEIGHT = np.random.default_rng(20_240_501).integers(1, 2**63, _PLACES, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
_K = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
#: Bytes that are scanned at a time; the arrays of a scan take some sixty times as many.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets, not copied where no row is null; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def scan(data: np.ndarray, offsets: np.ndarray):
    """Yields (first row, next row, bytes, row starts, word flags, word starts, hashes, words before each row).

    Row starts and word starts count from the start of the chunk; words before each row has one entry more than rows.
    """
    for i, j in chunks_of_rows(offsets, CHUNK):
        u = data[offsets[i] : offsets[j]]
        rows = offsets[i : j + 1] - offsets[i]
        word = IS_WORD[u]
        begins = word.copy()
        if len(u):
            begins[1:] &= ~word[:-1]
            edge = rows[:-1][rows[:-1] < len(u)]
            begins[edge] = word[edge]
        starts = np.flatnonzero(begins)
        if len(starts):
            place = np.arange(len(u), dtype=np.int64)
            first = np.repeat(starts, np.diff(np.append(starts, len(u))))
            place[starts[0] :] -= first
            at = np.flatnonzero(word)
            value = _LOWER[u[at]] * _WEIGHT[place[at] % _PLACES]
            hashes = mix(np.add.reduceat(value, np.flatnonzero(begins[at])))
        else:
            hashes = np.zeros(0, _U64)
        yield i, j, u, rows, word, starts, hashes, np.searchsorted(starts, rows)


def grams(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rolling k-gram hashes of the rows, and the flags of those that lie within one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U64), np.zeros(0, bool)
    out = np.zeros(n, _U64)
    for t in range(k):
        out += hashes[t : t + n] * _K[t]
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    return mix(out), row[:n] == row[k - 1 :]


def shingle_sets(column: pa.Array, k: int):
    """Yields (first row, next row, shingle hashes, shingles before each row): a row's k-word shingles.

    A row of fewer than k words has one shingle of all its words, a row without words none. Repeats are kept.
    """
    for i, j, _, _, _, _, hashes, before in scan(*text_bytes(column)):
        g, inside = grams(hashes, before, k)
        count = np.diff(before)
        row = np.repeat(np.arange(j - i), count)
        short = np.flatnonzero((count > 0) & (count < k))
        kept = g[inside]
        of = row[: len(g)][inside]
        if len(short):
            one = np.array([mix((hashes[before[r] : before[r + 1]] * _K[: count[r]]).sum(dtype=_U64, keepdims=True) + _U64(int(count[r])))[0] for r in short], dtype=_U64)
            kept, of = np.concatenate([kept, one]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            kept, of = kept[order], of[order]
        yield i, j, kept, np.searchsorted(of, np.arange(j - i + 1))
