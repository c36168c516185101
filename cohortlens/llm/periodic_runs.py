"""Periodic runs of words, found on a grammar.

A run is a maximal stretch of words with smallest period q and at least ``LEAST`` words and ``FOLD`` periods.
The word ids of a block of documents are compressed by Re-Pair: pairs of neighbouring symbols
that occur twice or more become nonterminals, the more frequent one first where two
overlap, until no pair is left to replace; what remains of a document is closed by a
balanced tree whose nodes occur once.  A run lies in a lowest derivation node and crosses that
node's boundary, so it is enough to look at boundaries, once for each nonterminal:

* one side of the boundary holds at least half of the run, so the ``GRAM`` words next to the
  boundary come again one period away; those places are the only periods tried;
* prefix sums of word codes compare two stretches at once, and a binary search extends them.

Runs of a nonterminal are then copied to all its derivation positions, and intervals of one period that lie in
another are dropped.  Word codes only rule places out: what is returned was compared word by word.

Nulls: a null text has no words; a row without an id is treated as any other.  Repeated rows
give repeated results.  Only ``doc_id`` and ``text`` are read, so extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textvec

LEAST = 24  # words of a run
FOLD = 3  # periods of a run
GRAM = 4  # LEAST / 2 words on one side, of which 2/3 are one period: LEAST / 6 words come again
CHUNK = 1 << 20  # places compared at once

_IDX = np.int64


# -- grammar -----------------------------------------------------------------

def _pair_priority(seq: np.ndarray, at: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """(kind, priority) of the pairs that begin at the symbols ``at``; priority 0: any other symbol, or a
    pair that occurs once.  Equal priority means the same kind."""
    kind = np.full(len(seq), -1, _IDX)
    priority = np.zeros(len(seq), _IDX)
    if len(at):
        encoded = pa.array(seq[at] * fresh + seq[at + 1]).dictionary_encode()
        found = encoded.indices.to_numpy().astype(_IDX)
        count = np.bincount(found)
        # ties in no order of the text, or a repeated passage would be replaced from one end only
        rank = count * (len(count) + 1) + np.random.default_rng(fresh).permutation(len(count))
        rank[count < 2] = 0
        kind[at], priority[at] = found, rank[found]
    return kind, priority


def _index_since(head: np.ndarray) -> np.ndarray:
    """Number of places since the last True of ``head``."""
    i = np.arange(len(head))
    return i - np.maximum.accumulate(np.where(head, i, 0))


def derivation(ids: np.ndarray, offs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, start, boundary, end) of every derivation node of at least ``least`` words.

    ``ids`` are the word ids of several documents, ``offs`` their offsets."""
    n = len(ids)
    out: list[tuple[np.ndarray, ...]] = []
    if n < least:
        return tuple(np.zeros(0, _IDX) for _ in range(4))  # type: ignore[return-value]
    seq, start = ids.astype(_IDX), np.arange(n)
    last = np.zeros(n, bool)
    last[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    fresh = int(seq.max()) + 1
    again = ~last  # pairs that may occur twice: not those counted once, unless a symbol of theirs is new

    def merge(at: np.ndarray, symbol: np.ndarray) -> None:
        nonlocal seq, start, last, again
        end = np.append(start, n)[at + 2]
        big = end - start[at] >= least
        out.append((symbol[big], start[at][big], start[at + 1][big], end[big]))
        seq[at], last[at] = symbol, last[at + 1]
        again[at] = again[at - 1] = True  # the first symbol has none before it: a last symbol's flag is not read
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, start, last, again = seq[keep], start[keep], last[keep], again[keep]

    while True:
        kind, priority = _pair_priority(seq, np.flatnonzero(again & ~last), fresh)
        again = priority > 0
        before, after = np.append(0, priority[:-1]), np.append(priority[1:], 0)
        odd = _index_since((priority != before) | (priority == 0)) & 1  # aaaa: every other pair
        at = np.flatnonzero((priority > 0) & (priority >= before) & (priority >= after) & (odd == 0))
        times = np.bincount(kind[at], minlength=1) if len(at) else np.zeros(1, _IDX)
        at = at[times[kind[at]] >= 2]
        if not len(at):
            break
        number = np.cumsum(times >= 2) - 1
        merge(at, fresh + number[kind[at]])
        fresh += int(number[-1]) + 1
    while not last.all():
        at = np.flatnonzero(~last & (_index_since(np.append(True, last[:-1])) % 2 == 0))
        merge(at, fresh + np.arange(len(at)))
        fresh += len(at)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


# -- runs across boundaries ------------------------------------------------------

class _Stretches:
    """Equality of stretches of words by prefix sums of codes."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        a, b = (int(x) | 1 for x in rng.integers(1, 2**63, 2))
        self.code = textvec.mix(ids.astype(np.uint64) * np.uint64(a) + np.uint64(b))
        self.power = np.full(len(ids) + 1, a ^ (b << 1) & (2**64 - 1) | 1, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code * self.power[:-1], dtype=np.uint64)])

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``i`` are those from ``j``; i <= j."""
        s = self.sums
        return (s[i + n] - s[i]) * self.power[j - i] == s[j + n] - s[j]

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on agree, up to ``most``."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.equal(i, j, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.minimum(hi, mid - 1))
        return lo

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and ``j`` agree, up to ``most``."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.equal(i - mid, j - mid, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.minimum(hi, mid - 1))
        return lo


def _chunks(count: np.ndarray) -> Iterator[slice]:
    """Slices of rows with about CHUNK places in all; a row with more stands alone."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, side="right")))
        yield slice(lo, hi)
        lo = hi


def _expand(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of ``count`` places from ``lo`` on for each row."""
    row = np.repeat(np.arange(len(lo)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]


def crossing(same: _Stretches, start: np.ndarray, boundary: np.ndarray, end: np.ndarray, least: int = LEAST,
             fold: int = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs inside each node that cross its boundary, with the
    smallest period of each stretch."""
    n, code = len(same.code), same.code
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram[:n - GRAM + 1] += code[k:n - GRAM + 1 + k] * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (2**64 - 1))
    order = np.argsort(gram, kind="stable")
    group = np.cumsum(np.append(True, gram[order][1:] != gram[order][:-1])) - 1
    key = group * (n + 1) + order  # places of one gram in text order
    rank = np.empty(n, _IDX)
    rank[order] = np.arange(n)
    longest = (end - start) // fold
    half = least // 2
    found = []

    def tried(node: np.ndarray, lo: np.ndarray, count: np.ndarray, rightward: bool) -> None:
        count = np.maximum(count, 0)
        for part in _chunks(count):
            row, place = _expand(lo[part], count[part])
            who = node[part][row]
            s, b, e, j = start[who], boundary[who], end[who], order[place]
            q = j - b if rightward else b - GRAM - j
            need = np.maximum(half, (fold * q + 1) // 2)
            first = b if rightward else b - need
            ok = (b + need <= e) if rightward else (first >= s)
            who, s, b, e, q, need, first = (x[ok] for x in (who, s, b, e, q, need, first))
            ok = same.equal(first, first + q, need - q)
            who, s, b, e, q = (x[ok] for x in (who, s, b, e, q))
            i = b if rightward else b - q
            r, l = same.right(i, i + q, e - i - q), same.left(i, i + q, i - s)
            ok = l + q + r >= np.maximum(least, fold * q)
            found.append((who[ok], (i - l)[ok], (i + q + r)[ok], q[ok]))

    node = np.flatnonzero(end - boundary >= half)
    at = rank[boundary[node]]
    far = np.minimum(end[node] - GRAM, boundary[node] + longest[node])
    tried(node, at + 1, np.searchsorted(key, group[at] * (n + 1) + far, side="right") - at - 1, True)
    node = np.flatnonzero(boundary - start >= half)
    at = rank[boundary[node] - GRAM]
    far = np.maximum(start[node], boundary[node] - GRAM - longest[node])
    lo = np.searchsorted(key, group[at] * (n + 1) + far, side="left")
    tried(node, lo, at - lo, False)
    who, s, e, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, _IDX),) * 4
    by = np.lexsort((q, e, s, who))
    who, s, e, q = who[by], s[by], e[by], q[by]
    keep = np.ones(len(who), bool)
    keep[1:] = (who[1:] != who[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return who[keep], s[keep], e[keep], q[keep]


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that lie in no other of their period, by start and period."""
    by = np.lexsort((-e, s, q))
    s, e, q = s[by], e[by], q[by]
    reach = np.cumsum(np.append(0, q[1:] != q[:-1])) * (n + 1) + e if len(q) else e
    keep = np.ones(len(q), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    s, e, q = s[keep], e[keep], q[keep]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def _verified(ids: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    for part in _chunks(e - s):
        row, place = _expand(s[part], (e - s - q)[part])
        if (ids[place] != ids[place + q[part][row]]).any():
            return False
    return True


def runs_of(ids: np.ndarray, offs: np.ndarray, least: int = LEAST, fold: int = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a block of documents, by start and period."""
    symbol, s, b, e = derivation(ids, offs, least)
    none = np.zeros(0, _IDX)
    if not len(symbol):
        return none, none, none
    by = np.argsort(symbol, kind="stable")
    symbol, s, b, e = symbol[by], s[by], b[by], e[by]
    first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
    times = np.diff(np.append(first, len(symbol)))
    for seed in range(8):
        who, lo, hi, q = crossing(_Stretches(ids, seed), s[first], b[first], e[first], least, fold)
        row, node = _expand(first[who], times[who])
        shift = s[node] - s[first[who[row]]]
        start, end, period = _maximal(lo[row] + shift, hi[row] + shift, q[row], len(ids))
        if _verified(ids, start, end, period):
            return start, end, period
    raise ArithmeticError("word codes collide for every seed")


# -- Spark -------------------------------------------------------------------

class Block:
    """Words of some documents and their runs."""

    def __init__(self, keys: list, data: np.ndarray, offs: np.ndarray, edit: Callable | None, least: int, fold: int):
        begin, length, doc = textvec.words(data, offs)
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(length, dtype=np.int32)])
        compact = np.ascontiguousarray(data[textvec._IS_WORD[data]])
        self.words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(compact)])
        self.offs = np.searchsorted(doc, np.arange(len(keys) + 1))
        ids = self.words.dictionary_encode().indices.to_numpy().astype(_IDX)
        self.origin = np.arange(len(ids))
        if edit is not None:
            edit(keys, self.offs, self.origin)
            ids = ids[self.origin]
        self.start, self.end, self.period = runs_of(ids, self.offs, least, fold)
        self.doc = np.searchsorted(self.offs, self.start, side="right") - 1

    def runs(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(document, [(start, length, period)]) of documents with runs."""
        first = np.searchsorted(self.doc, np.arange(len(self.offs)))
        for d in np.unique(self.doc).tolist():
            a, b = first[d], first[d + 1]
            s = self.start[a:b]
            yield d, list(zip((s - self.offs[d]).tolist(), (self.end[a:b] - s).tolist(), self.period[a:b].tolist(), strict=True))

    def collapsed(self) -> pa.Array:
        """Each document's words without those that a run repeats, joined by one space."""
        n = len(self.origin)
        step = np.bincount(self.start + self.period, minlength=n + 1) - np.bincount(self.end, minlength=n + 1)
        keep = np.cumsum(step)[:n] == 0
        kept = np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])[self.offs]
        chosen = self.words.take(pa.array(self.origin[keep]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), chosen), b" ")


def _blocks(batches: Iterator[pa.RecordBatch], edit: Callable | None, least: int, fold: int) -> Iterator[tuple[list, Block]]:
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        for lo, hi, data, offs in textvec.blocks(batch.column("text")):
            yield keys[lo:hi], Block(keys[lo:hi], data, offs, edit, least, fold)


def _mapped(docs: DataFrame, emit: Callable, schema: str, edit: Callable | None, least: int, fold: int) -> DataFrame:
    def run(batches):
        for keys, block in _blocks(batches, edit, least, fold):
            yield from emit(keys, block)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """One row per run: ``doc_id, start, length, period`` (word numbers and counts).  ``least`` is at least 24, ``fold`` at least 3."""
    if least < LEAST or fold < FOLD:
        raise ValueError(f"a run has at least {LEAST} words and {FOLD} periods")

    def emit(keys, block):
        rows = [(keys[d], *run) for d, found in block.runs() for run in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "length", "period"])

    return _mapped(docs, emit, "doc_id long, start long, length long, period long", None, least, fold)


def collapsed(docs: DataFrame, least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """``doc_id, text``: each text's words joined by one space, each run cut to its first period."""
    def emit(keys, block):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), block.collapsed().cast(pa.string())], names=["doc_id", "text"])

    return _mapped(docs, emit, "doc_id long, text string", None, least, fold)


def plant(keys: list, offs: np.ndarray, origin: np.ndarray) -> None:
    """Make the words of every tenth document (by CRC of its id) periodic from some word on; a
    row without an id stays as it is."""
    for d, key in enumerate(keys):
        n = int(offs[d + 1] - offs[d])
        if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        origin[offs[d] + a:offs[d + 1]] = offs[d] + a + np.arange(n - a) % p


NONE_SHA = hashlib.sha256(b"").hexdigest()
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:  # by start and period already
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the strongest run and digests of all runs and of the collapsed text, of every
    document with planted periods (see ``plant``).  A text without words has no run and an empty
    collapsed text; repeated rows are judged each."""
    def emit(keys, block):
        rows = [(key, 0, None, None, None, None, NONE_SHA) for key in keys]
        for d, found in block.runs():
            s, n, q = _strongest(found)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
            rows[d] = (keys[d], len(found), s, n, q, 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest())
        texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in block.collapsed()]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string()), pa.array(texts, pa.string())],
                                         names=[f.split()[0] for f in DIGEST.split(", ")])

    return _mapped(docs, emit, DIGEST, plant, LEAST, FOLD)
