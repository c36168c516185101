"""Vectorised text helpers for Arrow tasks: words, word hashes and shingles.

A word is a run of bytes outside space and ``\\t..\\r``; the white-space bytes are
ASCII, so the split works on UTF-8 bytes.  All functions take the concatenated
UTF-8 bytes of several documents with their offsets, so one numpy pass serves a
whole block of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
BLOCK_BYTES = 512 << 10

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [int(x) | 1 for x in _rng.integers(1, 2**63, SHINGLE_WORDS + 1, dtype=np.uint64)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = 0x9E3779B97F4A7C15
_powers = _inverse = np.ones(1, np.uint64)


def _accumulated(radix: int, n: int) -> np.ndarray:
    out = np.full(max(n, 64), radix, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """``_RADIX ** 0 .. n-1`` modulo 2**64; grows with the longest word or block seen."""
    global _powers
    if len(_powers) < n:
        _powers = _accumulated(_RADIX, n)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """``_RADIX ** -0 .. -(n-1)`` modulo 2**64."""
    global _inverse
    if len(_inverse) < n:
        _inverse = _accumulated(pow(_RADIX, -1, 1 << 64), n)
    return _inverse[:n]


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return _BYTE_CODE[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64)[array.offset:array.offset + len(array) + 1] if offs else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def blocks(array: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents, each of about
    ``size`` bytes; a longer document stands alone."""
    data, offs = utf8(array)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes unchanged."""
    return _LOWER[data]


def per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each document."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return per_document((data & 0xC0) != 0x80, offs)


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word: of each run of bytes that ``is_word`` marks."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offs] = False  # a document's first byte has no word before it
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offs] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end - start, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum()))
    inner = at - np.repeat(first, length)
    code = _BYTE_CODE[data[inner + np.repeat(start, length)]] * powers(int(length.max()))[inner]
    return mix(np.add.reduceat(code, first) + length.astype(np.uint64))


def shingles(hashes: np.ndarray, document: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each window of ``k`` words, in text order, repeats included.
    A document with fewer words gives its whole sequence as one shingle."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.diff(document, prepend=-1))
    count = np.diff(np.append(head, n))
    if n >= k:
        ok = np.flatnonzero(document[:n - k + 1] == document[k - 1:])
        code = np.zeros(len(ok), np.uint64)
        for j in range(k):
            code += hashes[ok + j] * np.uint64(_STEP[j])
        out, doc = mix(code), document[ok]
    else:
        out, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero(count < k)
    if len(few):
        code = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            code[has] += hashes[head[few][has] + j] * np.uint64(_STEP[j])
        code = mix(code + count[few].astype(np.uint64) * np.uint64(_STEP[k]))
        out, doc = np.concatenate([out, code]), np.concatenate([doc, document[head[few]]])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's distinct shingles, by document and hash."""
    start, length, doc = words(data, offs)
    code, doc = shingles(word_hashes(data, start, length), doc, k)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    if len(code):
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        code, doc = code[keep], doc[keep]
    return code, doc
