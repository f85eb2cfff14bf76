"""Vectorised word and shingle hashes over Arrow string batches.

A batch's bytes are hashed without a Python loop over words: a prefix sum of
byte * p**position (mod 2**64) gives every word's polynomial hash, which is then
mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_CHUNK = 256 << 10
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = []

#: Words as runs of anything but ASCII white space; only A-Z are folded.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words as runs of ASCII letters, digits and any non-ASCII character.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHAR = bytes(0 if 128 <= b < 192 else 1 for b in range(256))  # 0: UTF-8 continuation bytes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_P, _PINV):
            t = np.full(max(n, _CHUNK + 1), base, np.uint64)
            t[0] = 1
            _powers.append(np.cumprod(t, dtype=np.uint64))
    return _powers


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    starts: np.ndarray  # byte positions in the chunk
    ends: np.ndarray
    offsets: np.ndarray  # word offsets of the documents, one more than documents
    stems: np.ndarray | None = None  # uint64, of each word's first characters


def _segment_words(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray, stem: int) -> list[np.ndarray]:
    n = len(data)
    raw = data.tobytes()
    m = np.frombuffer(raw.translate(is_word.tobytes()), bool)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[cuts[(cuts > 0) & (cuts <= n)] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = np.frombuffer(raw.translate(_FOLD), np.uint8).astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[:n]
    np.cumsum(terms, out=sums[1:])
    base, back = sums[starts], inverse[starts]
    found = [mix((sums[ends] - base) * back + (ends - starts).astype(np.uint64) * np.uint64(_P)), starts, ends]
    if stem:
        chars = np.frombuffer(raw.translate(_CHAR), bool)
        first = np.append(np.flatnonzero(chars), np.full(stem, n))
        short = np.minimum(ends, first[np.minimum(np.cumsum(chars)[starts] - 1 + stem, len(first) - 1)])
        found.append(mix((sums[short] - base) * back + (short - starts).astype(np.uint64) * np.uint64(_P)))
    return found


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORDS, stem: int = 0) -> Words:
    """Hashes of all words of the documents that lie in data at offsets, A-Z folded. Long inputs go in
    segments cut between words. stem: hash each word's first so many characters too."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _SEGMENT)
        if end < n:
            gap = np.flatnonzero(~is_word[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:  # a word longer than a segment
                rest = np.flatnonzero(~is_word[data[end:]])
                end = end + int(rest[0]) if len(rest) else n
        inside = offsets[(offsets >= at) & (offsets <= end)] - at
        h, s, e, *more = _segment_words(data[at:end], inside, is_word, stem)
        out.append((h, s + at, e + at, *more))
        at = end
    if not out:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    h, s, e, *more = out[0] if len(out) == 1 else (np.concatenate(x) for x in zip(*out))
    return Words(h, s, e, np.searchsorted(s, offsets), *more)


def chunks(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their offsets by document; a text of fewer words is one shingle, none has none."""
    h, n = w.hashes, len(w.hashes)
    count = np.diff(w.offsets)
    vals, keep = np.zeros(n, np.uint64), np.ones(n, bool)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc = mix(acc + h[i : n - k + 1 + i] + np.uint64(i + 1))
        vals[: n - k + 1] = acc
    first, last = w.offsets[:-1], w.offsets[1:]
    for j in range(1, k):
        keep[(last - j)[count >= j]] = False
    for j in range(1, k):
        at = first[count == j]
        acc = np.zeros(len(at), np.uint64)
        for i in range(j):
            acc = mix(acc + h[at + i] + np.uint64(i + 1))
        vals[at] = acc ^ np.uint64(0x5851F42D4C957F2D * j % (1 << 64))
        keep[at] = True
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    return vals[keep], np.concatenate([[0], np.cumsum(sizes)])
