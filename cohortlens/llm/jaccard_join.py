"""Exact near-duplicate components by an n-gram Jaccard join with T-occurrence search.

A document's set is its distinct 5-word shingles as 64-bit hashes; equal sets are one node.
Two sets link when 100 * both >= 75 * either.

1. Candidates.  With any one order of shingles, linked sets of n shingles share at least ``least_shared`` = l shingles
   among the first ``n - ceil(0.75 n) + l`` of each (the smaller l of the two).  The order puts shingles known as
   common last (a bounded list of the commonest; which are on it decides speed, not results), so these prefixes hold rare
   ones.  Tasks get the prefixes by shingle and return the distinct lists of nodes that share shingles, with how many.
   A node that shares too few for any link leaves all lists.
2. Stars.  The smallest node of a list is its centre, and is checked against the list's others.  All shingles that
   two sets share, but for those within both prefixes, lie behind one of the prefixes: a pair is read only if what it may share in
   its prefixes and the longer of what lies behind reach the required overlap.
3. Search.  A node stays in a neighbourhood only if a set of the sizes there could link to it by the same bound.  Links found so far join nodes into components.  Lists of one centre make up its neighbourhood; any two
   nodes of a list are in one.  A neighbourhood with several components is searched whole, in blocks of ``GROUP``
   nodes against ``GROUP``: nodes outside the commonest component are queries over the others.

A check of a query is a T-occurrence search (DivideSkip): its shingles give inverted lists over the block's nodes; the longest
are set aside, the short ones merged with a heap, and nodes that can still reach the required overlap are probed in the long
ones by binary search.  A group of thousands of near copies is linked through its centres; only what stays outside is searched
against the rest, and pairs are never made into rows.
"""

from __future__ import annotations

from collections.abc import Iterator
import heapq
from itertools import groupby
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import textvec as V
from .components import components
from .shared import giving_back, written

PERCENT = 75
COMMON_SHINGLES = 200_000  # shingles put last in the order
COMMON_FROM = 3  # times seen in one block of a task to be reported
REPORT_SHINGLES = 1 << 22  # shingles of such a block
HOT_FROM = 20_000  # reports beyond which a shingle's nodes are spread over tasks
SHARE = 8  # linked sets share one in so many of their shingles, at least, within their prefixes
GROUP = 512  # nodes of a block
FILTER_BITS = 24
HEAP_ITEMS = 2_000  # longer merges are done by one sort of the lists' concatenation
MU = 0.0085  # fixed value: DivideSkip's published weight for the number of long lists


def needed(n_a, n_b, percent: int = PERCENT):
    """Smallest overlap of two sets of these sizes that links them."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def least_shared(n):
    """Shingles that two linked sets share in their prefixes; the smaller set's number counts."""
    return 1 + n // SHARE


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + least_shared(n)


def _rest(n: str, percent: int) -> str:
    """SQL: shingles behind the prefix of a set of ``n``."""
    return f"(({percent} * {n} + 99) div 100 - 1 - {n} div {SHARE})"


def _short_of(n: str, m: str, percent: int) -> str:
    """SQL: how many shingles linked sets of these sizes share within both prefixes, at least.

    Of the two prefixes one ends first in the order; what is shared and not in both lies behind that one."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent} - greatest({_rest(n, percent)}, {_rest(m, percent)}))"


def _sets(batch: pa.RecordBatch, column: str = "text"):
    """(first row, end row, hashes, document, sizes, nodes) by block; documents without
    words have size 0 and node 0."""
    for lo, hi, data, offs in V.blocks(batch.column(column)):
        code, doc = V.shingle_sets(V.lowered(data), offs)
        n = np.bincount(doc, minlength=hi - lo)
        node = np.zeros(hi - lo, np.uint64)
        has = np.flatnonzero(n)
        if len(has):
            node[has] = V.mix(np.add.reduceat(V.mix(code ^ np.uint64(0x5851F42D4C957F2D)), np.searchsorted(doc, has)) + n[has].astype(np.uint64))
        yield lo, hi, code, doc, n, node.view(np.int64)


def _unseen(node: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """Documents with words whose node this task meets first; adds them to ``seen``."""
    out = np.zeros(len(node), bool)
    for i in np.flatnonzero(n).tolist():
        if (x := int(node[i])) not in seen:
            seen.add(x)
            out[i] = True
    return out


PROFILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])


def profile(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, node, n) and, with ``code`` set, shingles that a task saw
    ``COMMON_FROM`` times or more within one block of different sets."""

    def report(held):
        code, times = np.unique(np.concatenate(held), return_counts=True)
        at = times >= COMMON_FROM
        none = pa.nulls(int(at.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(code[at].view(np.int64)), pa.array(times[at])], names=PROFILE.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for lo, hi, code, doc, n, node in _sets(batch):
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(node), pa.array(n), none, none], names=PROFILE.fieldNames())
                held.append(code[_unseen(node, n, seen)[doc]])
                size += len(held[-1])
                if size >= REPORT_SHINGLES:
                    yield report(held)
                    held, size = [], 0
        if size:
            yield report(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), PROFILE)


PART = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("hot", T.BooleanType()),
                     T.StructField("codes", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
LIST = T.StructType([T.StructField("list_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("shared", T.LongType())])


def shared_lists(docs: DataFrame, common: np.ndarray, times: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(list_id, node, shared) rows of the lists of two or more nodes with common prefix
    shingles, and how many (to be summed over rows).  ``common`` (sorted) and ``times``: the known common shingles."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast((common, times))  # at most COMMON_SHINGLES entries

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = held.value
        seen: set = set()
        wait: list = []
        size = 0

        def flush():
            code, node, hot = (np.concatenate(x) for x in zip(*wait, strict=True))
            part = np.where(hot, V.mix(node.view(np.uint64)), code) % np.uint64(parts)
            key = part.astype(np.int64) * 2 + hot
            order = np.argsort(key, kind="stable")
            code, node, key = code[order], node[order], key[order]
            cut = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array([int(key[a]) // 2 for a, _ in spans], pa.int32()), pa.array([bool(key[a] % 2) for a, _ in spans]),
                pa.array([code[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([node[a:b].tobytes() for a, b in spans], pa.binary())],
                names=PART.fieldNames())

        for batch in batches:
            for _, _, code, doc, n, node in _sets(batch):
                keep = _unseen(node, n, seen)[doc]
                code, doc = code[keep], doc[keep]
                if not len(code):
                    continue
                at = np.minimum(np.searchsorted(common, code), max(0, len(common) - 1))
                often = np.where(common[at] == code, times[at], 0) if len(common) else np.zeros(len(code), np.int64)
                order = np.lexsort((code, often, doc))
                code, doc, often = code[order], doc[order], often[order]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                pre = place < prefix_length(n, percent)[doc]
                wait.append((code[pre], node[doc[pre]], often[pre] >= HOT_FROM))
                size += int(pre.sum())
                if size >= 1 << 20:
                    yield flush()
                    wait, size = [], 0
        if size:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for hot, c, n in zip(*(batch.column(x).to_pylist() for x in ("hot", "codes", "nodes")), strict=True):
                got[hot].append((np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64)))
        for hot, held in got.items():
            if not held:
                continue
            code, node = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((node, code))
            code, node = code[order], node[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (node[1:] != node[:-1])
            code, node = code[new], node[new]
            if hot:  # only a part of each list is here: it goes by its shingle
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(node), pa.array(np.ones(len(node), np.int64))], names=LIST.fieldNames())
                continue
            head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            count = np.diff(np.append(head, len(code)))
            of = np.add.reduceat(V.mix(node.view(np.uint64)), head)
            head, count, of = head[count > 1], count[count > 1], V.mix(of[count > 1]).view(np.int64)
            of, first, times = np.unique(of, return_index=True, return_counts=True)
            for lo in range(0, len(of), 1 << 14):
                rows = [node[head[i]:head[i] + count[i]] for i in first[lo:lo + (1 << 14)].tolist()]
                size = [len(r) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[lo:lo + (1 << 14)], size)) if x is not None else pa.array(np.concatenate(rows))
                                                  for x in (of, None, times)], names=LIST.fieldNames())

    return (docs.select("text").mapInArrow(giving_back(emit), PART).repartition(parts, "part").select("hot", "codes", "nodes")
            .mapInArrow(giving_back(gather), LIST))


# -- T-occurrence search ------------------------------------------------------

class Index:
    """Inverted lists over ``sets`` (sorted distinct hashes each)."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        code = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((member, code))
        self.member = member[order]
        self.code, at, self.length = np.unique(code, return_index=True, return_counts=True) if len(sets) == 1 else self._lists(code[order])
        self.start = at
        self.key = np.repeat(np.arange(len(self.code)), self.length) * len(sets) + self.member  # by list, then node

    @staticmethod
    def _lists(code: np.ndarray):
        head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[head], head, np.diff(np.append(head, len(code)))

    def search(self, query: np.ndarray, need: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Nodes among ``able`` (flags) that share at least ``need[i]`` hashes with ``query``."""
        n = len(self.size)
        at = np.minimum(np.searchsorted(self.code, query), len(self.code) - 1)
        at = at[self.code[at] == query]
        if not able.any() or len(at) < need[able].min():
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]  # short lists first
        least = int(need[able].min())
        long_n = min(int(least / (MU * math.log(max(2, int(self.length[at[-1]]))) + 1)), least - 1)
        short, long_ = at[:len(at) - long_n], at[len(at) - long_n:]
        total = int(self.length[short].sum())
        count = np.zeros(n, np.int64)
        if total <= HEAP_ITEMS:
            lists = [self.member[self.start[x]:self.start[x] + self.length[x]].tolist() for x in short]
            for m, run in groupby(heapq.merge(*lists)):
                count[m] = sum(1 for _ in run)
        else:
            first = np.cumsum(self.length[short]) - self.length[short]
            place = np.arange(total) + np.repeat(self.start[short] - first, self.length[short])
            m, c = np.unique(self.member[place], return_counts=True)
            count[m] = c
        may = np.flatnonzero(able & (count >= need - long_n))
        if len(may) and long_n:
            probe = (long_[:, None] * n + may).ravel()
            found = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            count[may] += (self.key[found] == probe).reshape(long_n, -1).sum(axis=0)
        return may[count[may] >= need[may]]


def block_links(names: list[int], labels: list[int], sets: list[np.ndarray], side: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join different labels of a block; with two sides only links between them.  One
    link for each pair of labels joined (the rest follow)."""
    top: dict[int, int] = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    values, code, count = np.unique(np.array(labels), return_inverse=True, return_counts=True)
    if len(values) < 2:
        return []
    side_ = np.array(side)
    two = len(set(side)) > 1
    index = Index(sets)
    own = code.copy()  # current label of each node
    out = []
    queries = np.flatnonzero(code != count.argmax())
    if two:  # or all of one side, if those are fewer
        queries = min(queries, *(np.flatnonzero(side_ == x) for x in np.unique(side_)), key=len)
    for q in queries.tolist():
        able = own != own[q]
        if two:
            able &= side_ != side_[q]
        need = needed(len(sets[q]), index.size, percent)
        able &= need <= np.minimum(index.size, len(sets[q]))
        for m in index.search(sets[q], need, able).tolist():
            if own[m] != own[q]:
                out.append((names[q], names[m]))
                own[own == own[m]] = own[q]
    return out


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over ``node`` (2**FILTER_BITS bits): rows it does not hold need not be
    shuffled.  When it fills up at a larger scale it lets more pass, nothing else."""
    bit = F.pmod(F.col("node"), F.lit(1 << FILTER_BITS))
    rows = (nodes.select(F.shiftright(bit, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {1 << FILTER_BITS}) & 31 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out


SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("codes", T.BinaryType())])


def _set_rows(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, codes) of the given nodes (and a few others), at least once each."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in batches:
            for _, _, code, doc, n, node in _sets(batch):
                place = node & ((1 << FILTER_BITS) - 1)
                wanted = (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1
                pick = np.flatnonzero(_unseen(node, np.where(wanted, n, 0), seen))
                cut = np.searchsorted(doc, np.append(pick, 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[pick]), pa.array([code[a:a + n[i]].tobytes() for a, i in zip(cut[:-1], pick, strict=True)], pa.binary())], names=SET.fieldNames())

    return docs.select("text").mapInArrow(giving_back(run), SET)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _searched(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within blocks.  ``members``: unit, i, j (a block's name), node, label, side."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = written(members.select("unit", "i", "j", "node", "label", "side"), "members", few=True)
    rows = members.join(_set_rows(docs, members), "node")  # tasks may send a set twice: equal rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish():
            if len(held) < 2:
                return []
            labels, sides, sets = zip(*held.values(), strict=True)
            return block_links(list(held), list(labels), list(sets), list(sides), percent)

        block, held, out = None, {}, []
        for batch in batches:
            codes = batch.column("codes")
            cols = [batch.column(c).to_pylist() for c in ("unit", "i", "j", "node", "label", "side")]
            for row, (u, i, j, node, label, side) in enumerate(zip(*cols, strict=True)):
                if (u, i, j) != block:
                    out += finish()
                    block, held = (u, i, j), {}
                held[node] = (label, side, np.frombuffer(codes[row].as_py(), np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=LINK.fieldNames())
                out = []
        if out := finish():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=LINK.fieldNames())

    return rows.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "node").mapInArrow(giving_back(search), LINK)


def star_links(docs: DataFrame, stars: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among ``stars`` (unit: the centre, node): the centre is one side, blocks of nodes the other."""
    per = stars.groupBy("unit").agg(F.count("*").alias("c"))
    nodes = stars.join(per, "unit").select("unit", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / GROUP)).alias("i"), "node", F.lit(1).alias("side"))
    centres = nodes.select("unit", "i", F.col("unit").alias("node"), F.lit(0).alias("side")).distinct()
    every = nodes.unionByName(centres)
    return _searched(docs, every.withColumn("j", F.lit(0).cast("long")).withColumn("label", F.col("node")), percent)


def neighbourhood_links(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different labels among ``members`` (unit, node, label) of a unit."""
    per = (members.groupBy("unit").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
           .where("lo <> hi AND c > 2").select("unit", F.ceil(F.col("c") / GROUP).alias("k")))
    rows = members.join(per, "unit").withColumn("side", F.pmod(F.xxhash64("node"), F.col("k")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return _searched(docs, rows.select("unit", F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "node", "label",
                                       F.col("side").cast("int").alias("side")), percent)


def _reachable(members: DataFrame, percent: int) -> DataFrame:
    """(unit, node) of the ``members`` (unit, node, n, w: what the node shares in all lists) that some set of the
    unit's sizes could link to.  What is asked of a pair is least at the smallest or the largest partner."""
    sizes = members.groupBy("unit").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    lo = F.greatest(F.expr(f"({percent} * n + 99) div 100"), F.col("least_n"))
    hi = F.least(F.expr(f"100 * n div {percent}"), F.col("most_n"))
    rows = members.join(sizes, "unit").withColumn("lo", lo).withColumn("hi", hi)
    slack = 3  # of the rounded terms between the ends
    return rows.where(f"w + {slack} >= least({_short_of('n', 'lo', percent)}, {_short_of('n', 'hi', percent)})").select("unit", "node")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document.

    A-Z count as lower case.  Null or wordless text: no shingles, a component of its own.  Rows
    with equal texts link; a null id never names a component with other ids; an empty table gives no
    rows; other columns are ignored."""
    seen = written(profile(docs), "profile")
    info = seen.where("code IS NULL").select("doc_id", "node", "n")
    top = (seen.where("code IS NOT NULL").groupBy("code").agg(F.sum("times").alias("times"))
           .orderBy(F.desc("times"), "code").limit(COMMON_SHINGLES).toPandas())
    common = top["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    lists = written(shared_lists(docs, common[order], top["times"].to_numpy(np.int64)[order], percent), "lists")
    size = info.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    # what a node shares with all others together must reach what a link to the smallest possible partner needs;
    # its lists lie together for its size, and are summed up there
    lists = (lists.groupBy("list_id", "node").agg(F.sum("shared").alias("shared")).join(size, "node")
             .withColumn("w", F.sum("shared").over(Window.partitionBy("node"))))
    lists = written(lists.where(f"w >= 1 + (({percent} * n + 99) div 100) div {SHARE}"), "lists-enough")
    first = lists.groupBy("list_id").agg(F.min(F.struct("node", "n")).alias("m"))
    stars = written(lists.join(first, "list_id").where(F.col("node") != F.col("m.node"))
                    .groupBy(F.col("m.node").alias("unit"), "node").agg(F.first("n").alias("n"), F.first("m.n").alias("m"), F.sum("shared").alias("s")), "stars", few=True)
    # lists of a pair that have another centre hold both as others: at most what the two share in such lists
    other = stars.groupBy("node").agg(F.sum("s").alias("u"))
    near = stars.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).join(other, "node")
    near = near.join(other.select(F.col("node").alias("unit"), F.col("u").alias("v")), "unit", "left")
    near = near.where(f"s + least(u - s, coalesce(v, 0)) >= {_short_of('n', 'm', percent)}")
    found = written(star_links(docs, near.select("unit", "node"), percent), "links")
    labels = components(found)

    members = stars.select("unit", "node", "n").unionByName(stars.select("unit", F.col("unit").alias("node"), F.col("m").alias("n")).distinct())
    members = _reachable(members.join(lists.groupBy("node").agg(F.first("w").alias("w")), "node"), percent)
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = written(neighbourhood_links(docs, members, percent), "links")
    if not more.isEmpty():
        labels = components(found.unionByName(more))
    named = info.join(labels, "node", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))
    lowest = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("lowest"))
    return named.join(lowest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("lowest", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
