"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``Encoder.merge`` lays any number of pre-tokens into one linked list of symbols (no
merge crosses a border).  A bucket per merge rank holds list positions; a bitmap of
three levels of 64-bit words finds the lowest rank with entries by find-first-set;
entries whose pair has changed meanwhile are stale and skipped.  All positions of a
bucket are merged in one vectorised step, so a step costs the same for one very long
pre-token as for many short ones, and the total work is about linear in the bytes.

Spark partitions the documents; each task keeps a bounded cache of encoded chunks.
"""

from __future__ import annotations

import base64
from contextlib import suppress
import hashlib
from functools import lru_cache
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import giving_back

# White space as the vocabulary's split pattern means it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
#: Chunks never split a match of the pre-token pattern: a word with the one space
#: before it, or a run of white space (without its last character if a word follows).
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_NONE = np.int32(2**31 - 1)
CACHE_ENTRIES = 120_000  # of each of two generations


class RankQueue:
    """Ranks 0 .. n-1 with a bucket of position arrays each; pops the lowest rank."""

    def __init__(self, n: int):
        self.levels = [[0] * (-(-n // 64))]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * (-(-len(self.levels[-1]) // 64)))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push ``positions`` into the buckets of their ``ranks``."""
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        lo = 0
        for hi in [*cut.tolist(), len(ranks)]:
            if hi > lo:
                self.push(int(ranks[lo]), positions[lo:hi])
            lo = hi

    def pop(self) -> tuple[int, np.ndarray] | None:
        """(lowest rank, its positions); None if empty."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) + (word & -word).bit_length() - 1
        rank, clear = at, at
        for level in self.levels:
            level[clear >> 6] &= ~(1 << (clear & 63))
            clear >>= 6
            if level[clear]:
                break
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Decoder:
    """A rank file's tokens by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder(Decoder):
    """A rank file's vocabulary.  ``pattern`` splits text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        super().__init__(self.ranks)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        #: Tokens that are part of a token of lower rank: merging one may open an earlier merge.
        self.early = np.zeros(self.size, bool)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
                    for part in (a, b):
                        if part > rank:
                            self.early[part] = True
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        #: Ids of the tokens that are texts of their own.
        self.whole: dict[str, bytes] = {}
        for token, rank in self.ranks.items():
            with suppress(UnicodeDecodeError):
                self.whole[token.decode()] = rank.to_bytes(4, "little")
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def opens(self, rank, sym, at, nxt, prev, border) -> np.ndarray:
        """Would merging the pair at each position make a pair of lower rank?"""
        after = nxt[nxt[at]]
        right = (self.pair_ranks(np.int64(rank), sym[after]) < rank) & ~border[after]
        return right | (self.pair_ranks(sym[prev[at]], np.int64(rank)) < rank) & ~border[at]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (not empty) by merging alone."""
        length = np.array([len(x) for x in pieces], np.int64)
        sym = np.append(self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        n = len(sym) - 1
        nxt, prev = np.arange(1, n + 2), np.arange(-1, n)  # one position beyond the end
        alive = np.ones(n, bool)
        pair = np.full(n + 1, _NONE, np.int32)  # rank of the pair that begins here
        mark = np.zeros(n + 1, bool)
        border = np.zeros(n + 1, bool)  # a pre-token begins here
        border[np.cumsum(length) - length] = True
        border[n] = True
        piece = np.cumsum(border)
        if n > 1:
            pair[:n - 1] = np.where(border[1:n], _NONE, self.pair_ranks(sym[:n - 1], sym[1:n]))
        queue = RankQueue(self.size)
        at = np.flatnonzero(pair != _NONE)
        queue.push_all(pair[at], at)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[pair[at] == rank]  # stale entries go
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                touch = nxt[at[:-1]] == at[1:]
                keep = None
                if self.early[rank]:
                    # In each pre-token up to the first merge that opens a lower rank, or
                    # up to one beside its forerunner.
                    head = np.diff(piece[at], prepend=-1) != 0
                    stop = np.zeros(len(at), bool)
                    stop[1:] = self.opens(rank, sym, at, nxt, prev, border)[:-1] | touch | (nxt[nxt[at[:-1]]] == at[1:])
                    stop = np.cumsum(stop & ~head)
                    keep = stop == np.maximum.accumulate(np.where(head, stop, 0))
                elif touch.any():  # overlapping pairs: leftmost first, then each second of the run
                    run = np.concatenate([[0], np.cumsum(~touch)])
                    first = np.concatenate([[0], np.flatnonzero(~touch) + 1])
                    keep = (np.arange(len(at)) - first[run]) % 2 == 0
                if keep is not None and not keep.all():
                    queue.push(rank, at[~keep])
                    at = at[keep]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = rank
            alive[gone] = False
            pair[gone] = _NONE
            nxt[at] = after
            prev[after] = at
            left = prev[at]
            left = left[(left >= 0) & ~border[at]]
            # at and left may hold the same position when two merges touch
            mark[at] = True
            begin = np.concatenate([at, left[~mark[left]]])
            mark[at] = False
            end = nxt[begin]
            open_ = ~border[end]
            new = np.full(len(begin), _NONE, np.int32)
            new[open_] = self.pair_ranks(sym[begin[open_]], sym[end[open_]])
            pair[begin] = new
            has = new != _NONE
            if has.any():
                queue.push_all(new[has], begin[has])
        ids = sym[:n][alive].astype("<u4")
        end = (4 * np.cumsum(np.add.reduceat(alive, np.cumsum(length) - length, dtype=np.int64))).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *end], end, strict=False)]

    def encode_pieces(self, pieces: list[str]) -> None:
        """Fill the cache of pre-tokens: a whole token is taken as it is, the rest merged."""
        whole = self.whole
        self.pieces.update((x, whole[x]) for x in pieces if x in whole)
        merge = [x for x in pieces if x not in whole]
        if merge:
            self.pieces.update(zip(merge, self.merge([x.encode() for x in merge]), strict=True))

    def encode_all(self, texts: list[str], chars: int = 2 << 20) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        What is new in all texts is merged at once, as a step of ``merge`` costs much the same for few positions; the
        texts are cut into chunks by groups of ``chars`` characters, twice if there are several, so that few chunks are held."""
        groups = list(_groups(texts, chars))
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks, self.older = {}, self.chunks
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        missing: set[str] = set()
        for group in groups:
            found = [_CHUNK.findall(x) for x in group]
            missing |= set().union(*found).difference(self.chunks)
        if known := missing.intersection(self.older):
            self.chunks.update((x, self.older[x]) for x in known)
            missing -= known
        if missing:
            split = {x: self.pattern.findall(x) for x in missing}
            self.encode_pieces(list(set().union(*split.values()).difference(self.pieces)))
            pieces = self.pieces
            for x, parts in split.items():
                self.chunks[x] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        get = self.chunks.__getitem__
        if len(groups) == 1:
            return [b"".join(map(get, x)) for x in found]
        return [b"".join(map(get, _CHUNK.findall(x))) for x in texts]

@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    """One decoder per Python worker; it has no pairs and no caches."""
    return Decoder(read_ranks(path))


def _groups(texts: list[str], chars: int):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[lo:i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", block_chars: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (little-endian unsigned 32-bit integers as
    binary).  Null text counts as empty (no ids).  Repeated rows are encoded alike; an
    empty table stays empty.  Raises if ``docs`` already has a column ``ids``."""
    if "ids" in docs.columns:
        raise ValueError("a column named ids is there already")

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(column).to_pylist()]
            out = [x for group in _groups(texts, block_chars) for x in enc.encode_all(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them."""

    def run(batches):
        dec = decoder(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(dec.decode(x)).hexdigest() for x in ids])], names=DIGEST.fieldNames())

    return encode(docs.select(F.col("doc_id").cast("long"), "text"), path, pattern).select("doc_id", "ids").mapInArrow(giving_back(run), DIGEST)
