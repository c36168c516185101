"""Packing by minimum bin slack.

Documents become token ids (one tokenizer file, then an end id) and are cut into full
windows and one rest.  How many rests of each length there are is a histogram of at
most ``window`` numbers, whatever the corpus, so the packing plan is made from it:
``plan`` takes the longest remaining length, finds by a bitset subset-sum over the
remaining multiset the fill closest to the window, backtracks the counts, and repeats
that pattern as often as the counts allow.  Where the fill leaves a gap, one more rest is cut: its head
fills the gap and its tail goes back into the histogram, so that only the last sequence
is not full.  Pieces are then numbered within their length
by Spark (cut by a hash salt, so a length that holds a third of all pieces is spread over tasks) and
look up sequence, offset and cuts by that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import textvec
from .shared import written

WINDOW = 2048
END_ID = 1
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 60  # of a kept word beside its text and ids: offsets, and its place in a lookup's hash table
LONG_WORD = 100
JOINED = 500  # words given to the tokenizer as one text
MOST_TAILS = 5000  # runs of marks after a word whose ids are kept
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin a pre-token with letters
_NO_GAP = np.ones(256, bool)
_NO_GAP[[10, 32]] = False
_MARK, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[44, 46]] = True
_ALPHA[65:91] = _ALPHA[97:123] = True


class Words:
    """A tokenizer with a bounded cache of words.

    Cutting at spaces and line feeds is exact for tokenizers whose pre-tokens hold no
    white space and that drop it (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tails: dict[str, np.ndarray] = {}
        self.words = pa.array([], pa.binary())
        self.flat = np.zeros(0, "<u4")
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)  # of each word's ids
        self.again = np.zeros(0, bool)  # looked up since it came in or since the last cut
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = np.zeros(128, "<u4")
        for x in ".,":  # one id each
            self.marks[ord(x)], = self.tokenizer.encode(x, add_special_tokens=False).ids

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of each word.  Words of letters alone are one pre-token each, so many go in as one
        text, and an id that ends a pre-token ends a word; marks after the last letter are a pre-token of their own."""
        cores = [x.rstrip(MARKS) for x in texts]
        plain = [i for i, x in enumerate(cores) if x.isalpha()]
        single = [i for i, x in enumerate(cores) if not x.isalpha()]
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        order, sizes, parts = [], [], []
        joined = self.tokenizer.encode_batch_fast([" ".join([cores[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(group):  # a letter became a letter and a mark
                single += group
                continue
            tails = [(k, texts[i][len(cores[i]):]) for k, i in enumerate(group) if len(cores[i]) < len(texts[i])]
            if tails:
                for x in {x for _, x in tails} - self.tails.keys():
                    self.tails[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4")
                more = [self.tails[x] for _, x in tails]
                at, n = end[[k for k, _ in tails]], [len(x) for x in more]
                ids = np.insert(ids, np.repeat(at, n), np.concatenate(more))
                step = np.zeros(len(end), np.int64)
                step[[k for k, _ in tails]] = n
                end += np.cumsum(step)
            order += group
            sizes.append(np.diff(end, prepend=0))
            parts.append(ids)
            if len(self.tails) > MOST_TAILS:
                self.tails = {}
        for e in self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False):
            parts.append(np.array(e.ids, "<u4"))
            sizes.append([len(parts[-1])])
        first, count = np.zeros((2, len(texts)), np.int32)
        if texts:
            size = np.concatenate(sizes)
            count[order + single], first[order + single] = size, np.cumsum(size) - size
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), first, count

    def cut(self) -> None:
        """Keep no word over ``LONG_WORD`` bytes (texts without spaces); above ``CACHE_BYTES``, at most half of that in words
        that were looked up again."""
        size = np.diff(np.frombuffer(self.words.buffers()[1], np.int32)[:len(self.words) + 1]) if len(self.words) else np.zeros(0, np.int32)
        cost, keep = size + 4 * self.count + ENTRY_BYTES, size <= LONG_WORD
        full = cost[keep].sum() > CACHE_BYTES
        if full:
            keep &= self.again
            keep &= np.cumsum(np.where(keep, cost, 0)) <= CACHE_BYTES // 2
        if keep.all():
            return
        count = self.count[keep]
        at = np.cumsum(count, dtype=np.int32) - count
        inner = np.arange(int(count.sum()), dtype=np.int32) - np.repeat(at, count)
        self.flat = self.flat[inner + np.repeat(self.first[keep], count)]
        self.words, self.first, self.count = self.words.filter(pa.array(keep)), at, count
        self.again = np.zeros(len(at), bool) if full else self.again[keep]

    def known(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of some distinct words: word i has the ``count[i]`` ids from ``first[i]``."""
        self.cut()
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        self.again[at[~new]] = True
        if new.any():
            missing = words.filter(pa.array(new))
            at[new] = np.arange(len(missing)) + len(self.words)
            ids, first, count = self.encoded(missing.cast(pa.string()).to_pylist())
            self.words = pa.concat_arrays([self.words, missing])
            self.first, self.count = np.concatenate([self.first, first + np.int32(len(self.flat))]), np.concatenate([self.count, count])
            self.flat, self.again = np.concatenate([self.flat, ids]), np.concatenate([self.again, np.zeros(len(missing), bool)])
        return self.flat, self.first[at], self.count[at]

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, document offsets) of texts as UTF-8 bytes: each distinct word is looked up once, and
        all ids are gathered at once.

        One ``.`` or ``,`` after an ASCII letter is split off and a word of ASCII alone lower-cased, as
        the tokenizer itself does with either; other words stay whole."""
        start, size, doc = textvec.words(data, offs, _NO_GAP)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        last = start + size - 1
        marked = (size > 1) & _MARK[data[last]] & _ALPHA[data[np.maximum(last - 1, 0)]]
        keep = _NO_GAP[data]
        keep[last[marked]] = False
        low, wide = textvec.lowered(data), np.concatenate([np.zeros(1, np.int32), np.cumsum(data > 127, dtype=np.int32)])
        odd = wide[start + size] > wide[start]
        if odd.any():
            step = np.zeros(len(data) + 1, np.int8)
            step[start[odd]] += 1
            step[(start + size)[odd]] -= 1
            low = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, data, low)
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size - marked, dtype=np.int32)])
        words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low[keep])]).dictionary_encode()
        flat, first, count = self.known(words.dictionary)
        code = words.indices.to_numpy()
        n = count[code]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n + marked)])
        inner = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        out = np.empty(total[-1], "<u4")
        out[inner + np.repeat(total[:-1].astype(np.int32), n)] = flat[inner + np.repeat(first[code], n)]
        out[total[1:][marked] - 1] = self.marks[data[last[marked]]]
        return out, total[np.searchsorted(doc, np.arange(len(offs)))]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One tokenizer and cache per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    return Words(path)


PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                      T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
           block_bytes: int = 2 << 20) -> DataFrame:
    """Full windows and the rest of each document.  Null text counts as empty: its only id is
    ``end_id``.  ``ids`` (binary) is null for full windows unless ``keep_ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = words(path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in textvec.blocks(batch.column("text"), block_bytes):
                plain, begin = tok.ids(data, offs)
                sizes = np.diff(begin) + 1  # with the end id
                begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                ids = np.full(begin[-1], end_id, "<u4")
                ids[np.arange(len(plain)) + np.repeat(np.arange(hi - lo), sizes - 1)] = plain
                raw, out = memoryview(ids.view(np.uint8)), []
                for key, b, n in zip(keys[lo:hi], begin.tolist(), sizes.tolist(), strict=False):
                    for s in range(0, n, window):
                        size = min(window, n - s)
                        part = raw[4 * (b + s):4 * (b + s + size)]
                        out.append((key, s, size, zlib.crc32(part), n, part.tobytes() if keep_ids or size < window else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)],
                                                 names=PIECE.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


# -- plan ------------------------------------------------------------------

def best_fill(counts: dict[int, int], capacity: int, totals: list[int]) -> dict[int, int]:
    """Lengths (with counts) from the multiset ``counts`` whose sum is the first of ``totals`` that
    can be reached, else the largest sum up to ``capacity``.

    Bit s of ``reach`` says that s can be made; the bitset before each step is kept, so the
    counts are read back from the sum."""
    reach, limit, steps = 1, (1 << (capacity + 1)) - 1, []
    # the commonest lengths first (by powers of two), so that what is plentiful is used up
    for length in sorted((x for x in counts if x <= capacity), key=lambda x: (counts[x].bit_length(), x), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... copies at once
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & limit
            left -= take
            chunk *= 2
        if reach >> totals[0] & 1:
            break
    total = next((t for t in totals if reach >> t & 1), reach.bit_length() - 1)
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


@dataclass
class Pattern:
    """A sequence's lengths with counts, and how often it is made."""

    used: dict[int, int]
    times: int
    cut: tuple[int, int] | None = None  # a further piece's length, and how much of its head goes in


def plan(counts: dict[int, int], window: int = WINDOW) -> list[Pattern]:
    """The sequences that hold all pieces: full windows and at most one shorter sequence.

    The tails of cut pieces are pieces of later patterns."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = best_fill(rest, window - longest, [window - longest])
        for x, n in used.items():
            rest[x] -= n
        used[longest] = used.get(longest, 0) + 1
        gap = window - sum(x * n for x, n in used.items())
        # what is left doesn't fit; the commonest length is cut
        cut = max((x for x, n in rest.items() if n), key=lambda x: (rest[x], x), default=None) if gap else None
        need = dict(used)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        if cut:
            counts[cut - gap] = counts.get(cut - gap, 0) + times
        out.append(Pattern(used, times, (cut, gap) if cut else None))
    return out


def _lookup(patterns: list[Pattern], counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, first sequence, copies in the pattern, offset, length of
    the head that is cut off or 0, number of the first tail).  Tails are numbered after the ``counts`` pieces of their length."""
    rows: dict[int, list] = {}
    seen: dict[int, int] = {}
    made = dict(counts)
    base = 0
    for p in patterns:
        offset = 0
        for length in sorted(p.used, reverse=True):
            n = p.used[length]
            rows.setdefault(length, []).append((seen.get(length, 0), base, n, offset, 0, 0))
            seen[length] = seen.get(length, 0) + n * p.times
            offset += n * length
        if p.cut:
            length, head = p.cut
            tail = length - head
            rows.setdefault(length, []).append((seen.get(length, 0), base, 1, offset, head, made.get(tail, 0)))
            seen[length] = seen.get(length, 0) + p.times
            made[tail] = made.get(tail, 0) + p.times
        base += p.times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placed(lookup: dict[int, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, skipped, length, sequence, offset) of what becomes of each piece: itself, or its
    parts in order, ``skipped`` ids after its start."""
    out = []
    row, skipped = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(row):
        found = np.zeros((len(row), 5), np.int64)  # sequence, offset, length, tail's length, tail's number
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            table = lookup[int(x)]
            r = table[np.searchsorted(table[:, 0], number[at], side="right") - 1]
            k = number[at] - r[:, 0]
            head = np.where(r[:, 4] > 0, r[:, 4], x)
            found[at] = np.stack([r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * x, head, x - head, r[:, 5] + k], axis=1)
        out.append((row, skipped, found[:, 2], found[:, 0], found[:, 1]))
        on = found[:, 3] > 0
        row, skipped, length, number = row[on], (skipped + found[:, 2])[on], found[on, 3], found[on, 4]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (row, skipped, length, number, number)


def numbered(parts: DataFrame) -> DataFrame:
    """``parts`` plus ``number``: 0, 1, ... within each length, without a task that holds a
    whole length (salted row numbers plus the counts of the salts before)."""
    salts = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    return (salted.withColumn("_row", row).join(before, ["length", "_salt"])
            .withColumn("number", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before"))


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ``ids`` if asked for): every id in one piece, pieces of a sequence gapless from 0, exactly
    ``window`` ids in each sequence but one.

    Repeated rows are packed each for itself; an empty table gives no rows; other columns of
    ``docs`` are ignored.  The pieces are written once to the shared folder, so a lost executor
    costs no second tokenisation and no number is given twice."""
    parts = written(pieces(docs, path, window, end_id, keep_ids), "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan(counts, window)
    lookup = _lookup(patterns, counts)
    cut = sorted({p.cut[0] for p in patterns if p.cut} & set(counts))
    if not keep_ids:  # ids are needed for the checksums of cut pieces alone
        parts = parts.withColumn("ids", F.when(F.col("length").isin(cut), F.col("ids")))
    names = [f for f in PIECE.fieldNames() if keep_ids or f != "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("length").to_numpy()
            row, skipped, length, seq, offset = _placed(lookup, before, batch.column("number").to_numpy())
            out = {c: batch.column(c).take(pa.array(row)) for c in names}
            out["start"], out["length"] = pa.array(out["start"].to_numpy() + skipped), pa.array(length)
            halves = np.flatnonzero(length != before[row])
            if len(halves):
                crc, ids = out["ids_crc32"].to_numpy().copy(), batch.column("ids")
                whole = out["ids"].to_pylist() if keep_ids else None
                for i in halves.tolist():
                    part = ids[row[i]].as_py()[4 * skipped[i]:4 * (skipped[i] + length[i])]
                    crc[i] = zlib.crc32(part)
                    if keep_ids:
                        whole[i] = part
                out["ids_crc32"] = pa.array(crc)
                if keep_ids:
                    out["ids"] = pa.array(whole, pa.binary())
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*parts.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered(parts).mapInArrow(place, schema)
