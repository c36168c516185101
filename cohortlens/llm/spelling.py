"""Spelling variants by search schemes over a bidirectional FM-index.

A word and a near word differ by one inserted, deleted or replaced code point.  The edit lies in
one half of the word, so the other half is kept: each half in turn is matched exactly and the
match is extended across the other with one error.  Words that share the kept half (and
the length class) meet in one shard; a shard indexes its words, with a delimiter before each, as the cyclic text
and its reversal: two rank structures whose suffix-rank intervals move together, so a match grows to
either side.  Branches are made only for characters that follow in the text.

Where one kept half belongs to more than ``HOT_ROWS`` rows, the half with the edit is halved again and the rows
are keyed by all that is kept, until the groups are small or one code point is open: a group is
split by what its words are, none is cut.  An edit is counted at the end of the words' common prefix, which lies in one region only, so each
near word is found once and counts need no list of pairs.

Defined results: null texts have no words; in a row without an id no code point is deleted; repeated
rows count each; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read, so extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textvec
from .shared import written

LEAST_LENGTH = 7  # code points of a word
LEAST_TIMES = 2  # occurrences of a word
TYPO_EVERY = 31
FORM_TIMES = 10  # a form occurs this many times as often as its variant
SHARD_ROWS = 24_000
HOT_ROWS = 24_000
COUNTED = 200_000  # words that a task holds before it hands their counts on
BLOCK = 64

_IDX = np.int64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True


# -- words -----------------------------------------------------------------------

def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, bytes, code points, document) of each maximal run of ``[A-Za-z\\u00C0-\\u00FF]``: in UTF-8 those above ASCII
    are the byte C3 and one more."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    points = np.concatenate([np.zeros(1, _IDX), np.cumsum((data & 0xC0) != 0x80)])
    return start, end - start, points[end] - points[start], np.searchsorted(offs, start, side="right") - 1


def _block_counts(keys: list, data: np.ndarray, offs: np.ndarray, least: int, every: int) -> Iterator[tuple[bytes, int]]:
    start, size, points, doc = letter_runs(data, offs)
    long = points >= least
    start, size, doc = start[long], size[long], doc[long]
    if not len(start):
        return
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
    place = np.arange(int(ends[-1])) - np.repeat(ends[:-1] - start, size)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(textvec.lowered(data[place]))])
    encoded = words.dictionary_encode()
    known = encoded.dictionary.to_pylist()
    pair, times = np.unique(doc * len(known) + encoded.indices.to_numpy(), return_counts=True)
    who, word = pair // len(known), pair % len(known)
    begun = [zlib.crc32(f"{k}:".encode()) for k in keys]
    crc = np.array([zlib.crc32(known[w], begun[d]) for d, w in zip(who.tolist(), word.tolist(), strict=True)], _IDX)
    null = np.array([k is None for k in keys])
    typo = (crc % every == 0) & ~null[who]
    whole = np.bincount(word[~typo], weights=times[~typo], minlength=len(known)).astype(_IDX)
    yield from ((known[w], int(whole[w])) for w in np.flatnonzero(whole))
    for w, h, n in zip(word[typo].tolist(), crc[typo].tolist(), times[typo].tolist(), strict=True):
        text = known[w].decode()
        if len(text) > least:
            at = h % len(text)
            yield (text[:at] + text[at + 1:]).encode(), n


def counted(docs: DataFrame, least: int = LEAST_LENGTH, every: int = TYPO_EVERY) -> DataFrame:
    """``word, n``: how often each word occurs after the deletions, summed in the tasks and then by word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def full():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, data, offs in textvec.blocks(batch.column("text")):
                for word, n in _block_counts(keys[lo:hi], data, offs, least, every):
                    held[word] = held.get(word, 0) + n
                if len(held) > COUNTED:
                    yield full()
                    held = {}
        yield full()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# -- index ---------------------------------------------------------------------

class Ranks:
    """How often a symbol, and all smaller ones, occur before a place of a text."""

    def __init__(self, text: np.ndarray, kinds: int):
        n = len(text)
        self.text, blocks = text, n // BLOCK + 1
        self.rows = np.full(blocks * BLOCK, 255, np.uint8)
        self.rows[:n] = text
        self.rows = self.rows.reshape(blocks, BLOCK)
        times = np.bincount(np.arange(n) // BLOCK * kinds + text, minlength=blocks * kinds).reshape(blocks, kinds)
        self.occ = np.zeros((blocks, kinds), np.int32)
        np.cumsum(times[:-1], axis=0, out=self.occ[1:])
        self.less = np.cumsum(self.occ, axis=1, dtype=np.int32) - self.occ
        total = np.bincount(text, minlength=kinds)
        self.first = np.cumsum(total) - total

    def at(self, i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = i // BLOCK
        row, symbol = self.rows[block], c[:, None].astype(np.uint8)
        inside = np.arange(BLOCK, dtype=np.uint8) < (i % BLOCK)[:, None].astype(np.uint8)
        return (self.occ[block, c] + np.count_nonzero((row == symbol) & inside, axis=1),
                self.less[block, c] + np.count_nonzero((row < symbol) & inside, axis=1))


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted rotations of a text that is no repetition of a shorter one, by prefix doubling."""
    n = len(text)
    rank, step = text.astype(_IDX), 1
    while True:
        key = rank * (n + 256) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = key[order]
        rank = np.empty(n, _IDX)
        rank[order] = np.cumsum(np.append(0, new[1:] != new[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class BiIndex:
    """The words ``$w1$w2...$wk`` as a cyclic text and its reversal.

    A match is (place, mirror, size): its suffix-rank interval in the text and in the reversal."""

    def __init__(self, symbols: np.ndarray, offs: np.ndarray, kinds: int):
        k = len(offs) - 1
        n = len(symbols) + k
        text = np.zeros(n, np.uint8)
        begin = offs[:-1] + np.arange(k)
        text[np.arange(len(symbols)) + np.repeat(np.arange(k), np.diff(offs)) + 1] = symbols
        self.order = rotations(text)
        self.word = np.full(n, -1, _IDX)
        self.word[begin] = np.arange(k)
        mirror = rotations(text[::-1])
        self.ranks = (Ranks(text[self.order - 1], kinds), Ranks(text[::-1][mirror - 1], kinds))
        self.n = n

    def start(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(m, _IDX), np.zeros(m, _IDX), np.full(m, self.n, _IDX)

    def extend(self, match: tuple, c: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matches with one more symbol on a side; size 0: none."""
        place, mirror, size = match
        ranks, lo, other = (self.ranks[1], mirror, place) if right else (self.ranks[0], place, mirror)
        a, b = ranks.at(lo, c), ranks.at(lo + size, c)
        lo, other = ranks.first[c] + a[0], other + b[1] - a[1]
        return (other, lo, b[0] - a[0]) if right else (lo, other, b[0] - a[0])

    def next_symbols(self, match: tuple, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group of each match, first child of each group, number of children, symbol of each child) without the
        delimiter.  Matches with one interval are one group; those of one depth lie apart, so no symbol is read twice."""
        lo, size = match[1 if right else 0], match[2]
        _, first, group = np.unique(lo, return_index=True, return_inverse=True)
        sizes = size[first]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[first], sizes)
        text = self.ranks[1 if right else 0].text
        code = np.unique(np.repeat(np.arange(len(first)), sizes) * 256 + text[at])
        code = code[code % 256 > 0]
        number = np.bincount(code // 256, minlength=len(first))
        return group, np.cumsum(number) - number, number, code


class Shard:
    """The words of one shard, and searches among them."""

    def __init__(self, words: pa.Array):
        points = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words.to_pylist()]
        self.length = np.array([len(p) for p in points], _IDX)
        self.offs = np.concatenate([np.zeros(1, _IDX), np.cumsum(self.length)])
        flat = np.concatenate(points)
        kinds, symbols = np.unique(flat, return_inverse=True)
        self.symbols = (symbols + 1).astype(np.uint8)  # letters: at most 90 kinds
        self.index = BiIndex(self.symbols, self.offs, len(kinds) + 1)

    def symbol(self, word: np.ndarray, at: np.ndarray, right: bool) -> np.ndarray:
        """Symbol ``at`` of the words read to the right, or to the left; the delimiter at their end."""
        n = self.length[word]
        inside = at < n
        place = self.offs[word] + np.where(inside, at if right else n - 1 - at, 0)
        return np.where(inside, self.symbols[np.minimum(place, len(self.symbols) - 1)], 0).astype(_IDX)

    def near(self, word: np.ndarray, kept: np.ndarray, until: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word, near word): those reached by matching the first ``kept`` symbols exactly, then going on in the
        direction with one error at ``kept .. until - 1`` (at the end too, where ``until`` is the length)."""
        index, length = self.index, self.length[word]
        match = index.start(len(word))
        for step in range(int(kept.max(initial=0)) + 1):  # the kept part from its inner end out, then the delimiter
            on = np.flatnonzero((step <= kept) & (match[2] > 0))
            at = kept[on] - 1 - step
            c = np.where(at >= 0, self.symbol(word[on], np.maximum(at, 0), right), 0)
            new = index.extend(tuple(x[on] for x in match), c, not right)
            for x, y in zip(match, new, strict=True):
                x[on] = y
        who, at = np.arange(len(word)), kept.copy()  # error-free matches
        wrong: list[np.ndarray] = [np.zeros(0, _IDX) for _ in range(5)]  # query, next symbol, match
        found = [np.zeros(0, _IDX)], [np.zeros(0, _IDX)]
        while len(who) or len(wrong[0]):
            new = [wrong]
            if len(wrong[0]):  # one exact step, delimiter included
                q, p, *m = wrong
                m = index.extend(tuple(m), self.symbol(word[q], p, right), right)
                alive = m[2] > 0
                done = alive & (p == length[q])
                found[0].append(word[q[done]])
                found[1].append(index.word[index.order[m[0][done]]])
                alive &= ~done
                new = [[q[alive], p[alive] + 1, *(x[alive] for x in m)]]
            on = (match[2] > 0) & ((at < until) | ((until == length[who]) & (at == length[who])))
            who, at, match, until = who[on], at[on], tuple(x[on] for x in match), until[on]
            if len(who):
                group, first, number, code = index.next_symbols(match, right)
                one = np.unique(group, return_index=True)[1]
                child = index.extend(tuple(np.repeat(x[one], number) for x in match), code % 256, right)
                times = number[group]
                state = np.repeat(np.arange(len(who)), times)
                kid = np.arange(len(state)) - np.repeat(np.cumsum(times) - times, times) + first[group][state]
                here = self.symbol(word[who], at, right)
                differs = code[kid] % 256 != here[state]
                state, kid = state[differs], kid[differs]
                q, p, m = who[state], at[state], [x[kid] for x in child]
                new.append([q, p, *m])  # inserted
                short = p < length[q]
                new.append([q[short], p[short] + 1, *(x[short] for x in m)])  # replaced
                gone = (at < length[who]) & (self.symbol(word[who], at + 1, right) != here)
                new.append([who[gone], at[gone] + 1, *(x[gone] for x in match)])  # deleted
                go = at < length[who]
                match = index.extend(tuple(x[go] for x in match), here[go], right)
                who, at, until = who[go], at[go] + 1, until[go]
            wrong = [np.concatenate(x) for x in zip(*new, strict=True)]
        return np.concatenate(found[0]), np.concatenate(found[1])

    def common_prefix(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two words, up to ``most``."""
        out, on = np.zeros_like(most), np.arange(len(a))
        step = 0
        while len(on):
            on = on[(step < most[on]) & (self.symbol(a[on], np.full(len(on), step), True) == self.symbol(b[on], np.full(len(on), step), True))]
            step += 1
            out[on] = step
        return out


NEAR = "word string, n_near long, best_n long, best string"


def search(rows: pa.Table) -> pa.Table:
    """Near words of a shard's words: per query row their number and the most frequent one (ties: the
    smallest in code-point order).  Columns: ``word, n, size, first, end`` (length class and open region)."""
    encoded = rows.column("word").combine_chunks().dictionary_encode()
    words = encoded.dictionary
    each = encoded.indices.to_numpy().astype(_IDX)
    size, first, end = (rows.column(c).to_numpy().astype(_IDX) for c in ("size", "first", "end"))
    shard = Shard(words)
    times = np.zeros(len(words), _IDX)
    times[each] = rows.column("n").to_numpy()
    query = size == shard.length[each]
    each, first, end = each[query], first[query], end[query]
    left = first == 0
    a, b = shard.near(each[~left], first[~left], end[~left], True)
    # an edit in a first part: from the other end; of the places that give one near word the common prefix's end counts
    c, d = shard.near(each[left], (shard.length[each] - end)[left], shard.length[each][left], False)
    open_until = np.zeros(len(words), _IDX)
    open_until[each[left]] = end[left]
    ok = shard.common_prefix(c, d, open_until[c]) < open_until[c]
    word, other = np.append(a, c[ok]), np.append(b, d[ok])
    place = np.empty(len(words), _IDX)
    place[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    by = np.lexsort((place[other], -times[other], word))
    word, other = word[by], other[by]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, _IDX)
    return pa.table({"word": words.take(pa.array(word[head])), "n_near": pa.array(np.diff(np.append(head, len(word))), pa.int64()),
                     "best_n": pa.array(times[other[head]], pa.int64()), "best": words.take(pa.array(other[head]))})


# -- Spark -------------------------------------------------------------------

def _keyed(rows: DataFrame) -> DataFrame:
    """A key of what a row keeps: the code points before its region and after it, and the length class."""
    after = F.col("size") - F.col("end")
    return rows.withColumn("key", F.xxhash64("size", "first", "end", F.expr("substring(word, 1, first)"), F.when(after > 0, F.expr("right(word, size - end)"))))


def regions(vocabulary: DataFrame, least: int = LEAST_LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each word once for each half that a word of its length, or of one code point more or less, may keep."""
    classes = vocabulary.withColumn("size", F.explode(F.expr("sequence(char_length(word) - 1, char_length(word) + 1)"))).where(F.col("size") >= least)
    half = F.floor(F.col("size") / 2).cast("int")
    cut = F.array(F.struct(F.lit(0).alias("first"), half.alias("end")), F.struct(half.alias("first"), F.col("size").alias("end")))
    rows = _keyed(classes.withColumn("r", F.explode(cut)).select("word", "n", "size", "r.first", "r.end"))
    while True:
        wide = F.col("end") - F.col("first") > 1
        hot = rows.where(wide).groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.lit(True).alias("hot"))
        if hot.isEmpty():
            return rows
        # at most one row of ``hot`` for ``hot_rows`` rows of the vocabulary: small enough to broadcast
        rows = rows.join(F.broadcast(hot), "key", "left")
        middle = F.floor((F.col("first") + F.col("end")) / 2).cast("int")
        parts = F.array(F.struct(F.col("first"), middle.alias("end")), F.struct(middle.alias("first"), F.col("end")))
        split = rows.where(F.col("hot") & wide).withColumn("r", F.explode(parts)).select("word", "n", "size", "r.first", "r.end")
        rows = written(rows.where(F.col("hot").isNull() | ~wide).drop("hot").unionByName(_keyed(split)), "spelling-regions")


def near_words(vocabulary: DataFrame, least: int = LEAST_LENGTH, shard_rows: int = SHARD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``word, n_near, form, form_n`` of the words with a near word; ``form`` is the most frequent near word."""
    rows = regions(vocabulary, least, hot_rows)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return (dealt.applyInArrow(search, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form reached from each word with one.  Each form is ``FORM_TIMES`` times as frequent as the one
    before, so the most frequent word bounds the chain; each round doubles the way gone."""
    top = forms.agg(F.max("form_n")).first()[0] or 1
    links, way = forms.select("word", F.col("form").alias("root")), 1
    while FORM_TIMES ** way < top:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        way *= 2
    return links


def grouped(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_TIMES, shard_rows: int = SHARD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``least`` code points and ``times`` occurrences."""
    vocabulary = written(counted(docs, least).where(F.col("n") >= times), "spelling-vocabulary")
    near = near_words(vocabulary, least, shard_rows, hot_rows)
    kept = F.col("form_n") >= FORM_TIMES * F.col("n")
    rows = written(vocabulary.join(near, "word", "left").select(
        "word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(kept, F.col("form_n")).alias("form_n")), "spelling-forms")
    linked = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
