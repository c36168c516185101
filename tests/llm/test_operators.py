"""Each operator against a brute-force version, on edge rows and on whole small tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import byte_bpe, components, fingerprints, jaccard_join, langid, packing, quality, queries, sharding, suffix_lm, textvec, token_rollup, url_cascade

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORDS.findall(lower(t))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(df):
    return df.limit(0)


# -- text helpers ------------------------------------------------------------

def test_words_and_shingles_match_python():
    texts = ["", "a", " a b\tc\x0bd  e f ", "x y z", None, "ü " * 7, "a\x1cb c"]
    for lo, hi, data, offs in textvec.blocks(pa.array(texts), 8):
        start, length, doc = textvec.words(data, offs)
        got = [(d, data[s:s + n].tobytes().decode()) for s, n, d in zip(start, length, doc, strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts[lo:hi]) for w in WORDS.findall(t or "")]
        _, owner = textvec.shingle_sets(data, offs)
        assert np.bincount(owner, minlength=hi - lo).tolist() == [len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if (w := WORDS.findall(t or "")) else 0 for t in texts[lo:hi]]


# -- 1 fingerprints -----------------------------------------------------------

def edited_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(k, t or "", (order[(i + 1) % len(order)][1] or "")) for i, (k, t) in enumerate(order)]


def test_fingerprints_edit_with_the_next_document(sample):
    got = {r.doc_id: r for r in fingerprints.against_neighbour(sample).collect()}
    by_text = {}
    for k, t, o in edited_pairs(pairs_of(sample)):
        h = len(t) // 2
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[:len(t) - h] + o[:h]).encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = (set(textvec.shingles(*_hashed(x))[0].tolist()) for x in (t, t[:len(t) - h] + o[:h]))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(true - r.near_edited) < 0.25 and 0 <= r.near_next <= 1
    assert len(got) == sample.count()


def _hashed(t):
    data, offs = textvec.utf8(pa.array([t]))
    s, n, d = textvec.words(data, offs)
    return textvec.word_hashes(data, s, n), d


def test_fingerprints_edge_rows(edge):
    got = fingerprints.against_neighbour(edge).collect()
    assert len(got) == edge.count() and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.against_neighbour(empty(edge)).collect() == []
    one = edge.where("doc_id = 4").transform(fingerprints.against_neighbour).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_near_pairs_are_verified(docs_of):
    base = [f"w{i}" for i in range(60)]
    other = base[:58] + ["q", "r"]
    members, pairs = fingerprints.near_pairs(docs_of([" ".join(base), " ".join(other), " ".join(base), "none", None]))
    node = {r.doc_id: r.node for r in members.collect()}
    assert node[0] == node[2] and set(node) == {0, 1, 2, 3}
    (pair,) = pairs.collect()
    assert {pair.node_a, pair.node_b} == {node[0], node[1]} and pair.likeness == pytest.approx(54 / 58)


# -- 2 quality rules -----------------------------------------------------------

def test_quality_matches_sql(spark, edge):
    unique = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])  # the SQL joins on the id
    assert quality.judged(edge).count() == edge.count()
    for df in (unique, empty(edge)):
        documents = df.toArrow()  # noqa: F841  read by DuckDB
        want = duckdb.sql(quality.judged_sql()).fetchall()
        got = [tuple(r) for r in quality.judged(df).collect()]
        key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_filter_on_the_ledger_stays_cheap_and_native(edge):
    df = quality.apply_policy(quality.ledger(edge), quality.POLICY).where("kept")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("xxhash64") <= 2
    df.collect()


def test_ablation_counts_from_bits(edge):
    led = quality.ledger(edge)
    bits = [r.rule_bits for r in led.collect()]
    got = {(r.policy, r.rule): (r.n_docs, r.n_rejected, r.n_failed, r.n_alone) for r in quality.ablation(led, [quality.BASE, quality.POLICY]).collect()}
    for p in (quality.BASE, quality.POLICY):
        for i, (name, _) in enumerate(quality.RULES):
            if p.bits >> i & 1:
                b = [x & p.bits for x in bits]
                assert got[p.version, name] == (len(b), sum(x != 0 for x in b), sum(x >> i & 1 for x in b), sum(x == 1 << i for x in b))


def test_taken_column_names_are_refused(edge):
    with pytest.raises(ValueError):
        quality.ledger(edge.withColumn("n_words", F.lit(1)))
    with pytest.raises(ValueError):
        byte_bpe.encode(edge.withColumn("ids", F.lit(1)), MULTI, P.PATTERN)
    with pytest.raises(ValueError):
        sharding.sharded(edge.withColumn("slot", F.lit(1)))
    with pytest.raises(ValueError):
        langid.predict(edge.withColumn("score", F.lit(1)), [], None)


# -- 3 token counts -----------------------------------------------------------

def tik(path):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.encoder(path, P.PATTERN).ranks, special_tokens={})


def test_rollup_history_matches_recount(spark, sample, tmp_path):
    one, two = P.path("byte_bpe_50k.tiktoken"), MULTI
    got = {tuple(r) for r in token_rollup.maintained(sample, ("a", one), ("b", two), P.PATTERN, str(tmp_path / "r")).collect()}
    least, want = {}, collections.defaultdict(lambda: [0, 0, 0])
    rows = sample.collect()
    for r in rows:
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    enc = {"a": tik(one), "b": tik(two)}
    for r in rows:
        if least[r.text] == r.doc_id:
            v = "a" if r.lang == "en" else "b"
            for i, x in enumerate((1, len(enc[v].encode_ordinary(r.text)), len(r.text))):
                want[r.source, r.lang, v][i] += x
    assert got == {(*k, *v) for k, v in want.items()}


def test_rollup_commits_once_and_recovers(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    schema = "doc_id long, source string, lang string, version string, n_tokens long, n_chars long, deleted boolean"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    totals = lambda: sorted((tuple(r) for r in store.totals().collect()), key=str)
    assert totals() == [] and store.batches() == []
    first = batch((1, "s", "en", "v", 5, 9, None), (2, "s", None, "v", 7, 9, False), (2, "s", None, "v", 3, 9, False), (None, None, "en", "v", 1, 1, None))
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert sorted(map(str, totals())) == sorted(map(str, [("s", "en", "v", 1, 5, 9), ("s", None, "v", 1, 7, 9), (None, "en", "v", 1, 1, 1)]))
    # a broken attempt leaves files without a marker: not read, then overwritten
    batch((9, "s", "en", "v", 99, 99, None)).select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars").write.parquet(str(tmp_path / "r/ledger/b2"))
    assert store.commit("b2", batch((1, "s", "en", "w", 6, 9, False), (2, None, None, None, 0, 0, True), (77, None, None, None, 0, 0, True)))
    assert sorted(map(str, totals())) == sorted(map(str, [("s", "en", "w", 1, 6, 9), (None, "en", "v", 1, 1, 1)]))


# -- 4 packing ------------------------------------------------------------------

def check_packing(df, window, rows):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter((k, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in rows)
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in df:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
    total = collections.Counter({k: sum(len(x[1]) for x in v) for k, v in docs.items()})
    assert total == collections.Counter({k: sum(len(b) * n for (j, b), n in want.items() if j == k) for k in {k for k, _ in want}})
    for (k, b), n in want.items():
        if n == 1 and sum(j == k for j, _ in want) == 1:
            assert b"".join(x[1] for x in sorted(docs[k])) == b
    return seqs


def test_packing_places_every_id_once(edge, sample):
    for df in (edge, sample):
        check_packing(packing.packed(df, P.path("word_bpe_49k.json"), keep_ids=True).collect(), 2048, pairs_of(df))
    assert packing.packed(empty(edge), P.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("hot", [{1030: 5000}, {1300: 3000, 900: 40, 12: 5}, {1100: 1000, **{x: 3 for x in range(1, 800, 3)}}])
def test_only_one_sequence_is_not_full(hot):
    patterns = packing.plan(hot, 2048)
    sizes = [sum(x * n for x, n in p.used.items()) + (p.cut[1] if p.cut else 0) for p in patterns]
    assert all(x == 2048 for x in sizes[:-1]) and sum(p.times for p in patterns) == -(-sum(x * n for x, n in hot.items()) // 2048)


def test_a_hot_length_is_cut_to_fill_the_windows(docs_of):
    rows = ["alpha beta gamma delta epsilon zeta eta theta"] * 60 + ["one two three"] * 3 + [None]
    df = docs_of(rows)
    for window in (16, 13):
        seqs = check_packing(packing.packed(df, P.path("word_bpe_49k.json"), window=window, keep_ids=True).collect(), window, pairs_of(df))
        sizes = [sum(n for _, n in s) for s in seqs.values()]
        assert sum(x < window for x in sizes) <= 1
    plain = packing.packed(df, P.path("word_bpe_49k.json"), window=13).collect()
    kept = packing.packed(df, P.path("word_bpe_49k.json"), window=13, keep_ids=True).drop("ids").collect()
    assert sorted(map(str, plain)) == sorted(map(str, kept))


def word_ids(tok, texts):
    ids, begin = tok.ids(*textvec.utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]


def test_words_with_marks_go_to_the_tokenizer_in_few_texts():
    tok = packing.Words(P.path("word_bpe_49k.json"))
    texts = [f"{a}{b}{c}é***" for a in "abcdefg" for b in "hijklmn" for c in "opqrst"]
    sent, real = [], tok.tokenizer

    class Counted:
        def encode_batch_fast(self, batch, **more):
            sent.extend(batch)
            return real.encode_batch_fast(batch, **more)

        def encode(self, text, **more):
            sent.append(text)
            return real.encode(text, **more)

    tok.tokenizer = Counted()
    assert word_ids(tok, texts) == [real.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(sent) < 10


@pytest.mark.parametrize("cache", [0, 3000, 24 << 20])
def test_cached_words_have_the_tokenizers_ids(monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE_BYTES", cache)
    monkeypatch.setattr(packing, "JOINED", 3)
    monkeypatch.setattr(packing, "MOST_TAILS", 2)
    tok = packing.Words(P.path("word_bpe_49k.json"))
    odd = ["don't", "don'", "it's,", "x'''", "İstanbul.", "É***", "é!!", "a≠", "ä≠.", "<|endoftext|>", "ab<|endoftext|>", "***", "'s",
           "a1,", "1.", "ﬁn...", "日本語。,", "İ̇!", "a\x00b.", "ß&&", "…,", "“.", "Ω`", "ñ^", "x" * 300, "é" * 200 + "!"]
    rng = np.random.default_rng(3)
    for _ in range(12):
        texts = [" ".join(rng.choice(odd + [f"w{'abcdefgh'[k]}é!" for k in rng.integers(0, 8, 4)], rng.integers(0, 9))) for _ in range(30)] + ["", None]
        assert word_ids(tok, texts) == [tok.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_best_fill_is_the_best_subset_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        items = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        cap = int(rng.integers(1, 90))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= cap}
        used = packing.best_fill(dict(collections.Counter(items)), cap, [cap])
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert not collections.Counter(used) - collections.Counter(items)


# -- 5 URL filter -----------------------------------------------------------------

def test_url_verdicts_match_sql(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/es/1?q#f", "a://b://c/d#e", "s://notexample.org/en/1", "s://example.org/en/19",
            "s://com/de/", "s://a.com.fr/de/", "s://casino.example.net", "s://x.casino/\n/y", "s://org"]
    pages = spark.createDataFrame([(i % 12, u, "h") for i, u in enumerate(urls)] + [(None, "s://org/", "h")], "page_id long, url string, html string")
    for df in (pages, empty(pages)):
        got = sorted(map(str, (tuple(r) for r in url_cascade.judged(df).collect())))
        rows = df.toArrow()  # noqa: F841
        assert got == sorted(map(str, duckdb.sql(url_cascade.judged_sql().replace("FROM pages", "FROM rows")).fetchall()))


@pytest.mark.parametrize("share", [0, 0.01, 0.5, 1])
def test_cascade_is_exact(spark, share):
    rng = np.random.default_rng(4)
    listed = rng.random(3000) < share
    keys = spark.createDataFrame([(f"k{i}", bool(x)) for i, x in enumerate(listed)] + [("k1", False)], "key string, listed boolean")
    table, shards = url_cascade.build(keys, shard_keys=1000)
    got = url_cascade.flag(keys.drop("listed").unionByName(spark.createDataFrame([(None,)], "key string")), "key", table, shards, block_bytes=500)
    out = [(r.key, r.listed) for r in got.collect()]
    assert len(out) == 3002 and shards == 3
    assert all(x is (k is not None and bool(listed[int(k[1:])])) for k, x in out)


# -- 6 LM scoring -----------------------------------------------------------------

def test_word_scores_and_counts(edge, sample):
    for df in (sample, edge):
        rows = pairs_of(df)
        toks = [(k, [*words(t), None]) for k, t in rows]
        c = collections.Counter()
        for k, t in toks:
            if k is not None and zlib.crc32(str(k).encode()) % 10:
                c.update(t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for k, t in toks)
        got = suffix_lm.scored(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert suffix_lm.scored(empty(edge)).collect() == []


def brute_tree(texts):
    """log10 probability of each text by the definition in the module's docstring."""
    D, pad = suffix_lm.DEPTH, b"\n" * suffix_lm.DEPTH
    streams = [pad + b"".join(w.encode() + b" " for w in words(t)) + b"\n" for t in texts]
    count = [collections.defaultdict(collections.Counter) for _ in range(D + 1)]
    for s in streams:
        for i in range(D, len(s)):
            for d in range(D + 1):
                count[d][s[i - d:i]][s[i]] += 1

    def p(ctx, x):
        c = count[len(ctx)].get(ctx)
        if not ctx:
            return (c[x] + len(c) / 256) / (sum(c.values()) + len(c))
        if c is None or not kept(ctx):
            return p(ctx[1:], x)
        return (c[x] + len(c) * p(ctx[1:], x)) / (sum(c.values()) + len(c))

    memo = {}

    def kept(ctx):
        if ctx not in memo:
            c = count[len(ctx)][ctx]
            size = sum(c.values())
            q = {x: p(ctx[1:], x) for x in c}
            gain = sum(n * math.log((n + len(c) * q[x]) / (size + len(c)) / q[x]) for x, n in c.items())
            memo[ctx] = size >= suffix_lm.MIN_COUNT and gain >= len(c)
        return memo[ctx]

    return [sum(math.log10(p(s[i - D:i], s[i])) for i in range(D, len(s))) for s in streams]


def test_tree_matches_definition_in_any_number_of_passes(docs_of, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "then", "there", "hen", "Ant", "ü"], 60)) for _ in range(12)] + ["", "zzz the"]
    df = docs_of(texts)
    want = brute_tree(texts)
    words_, states, ends = suffix_lm.learned(df)
    for rows in (suffix_lm.BLOCK_ROWS, 3):
        monkeypatch.setattr(suffix_lm.blocks, "__defaults__", (rows,))
        got = {r.doc_id: r.score for r in suffix_lm.score(df, words_, states, ends).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_contexts_grow_until_the_divergence_test_ends_them(docs_of, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["xabcdefghij1", "yabcdefghij2"], 30)) for _ in range(8)]  # the digit follows from 11 bytes before
    with monkeypatch.context() as m:
        m.setattr(suffix_lm, "DEPTH", 24)
        want = brute_tree(texts)
    df = docs_of(texts)
    got = {r.doc_id: r.score for r in suffix_lm.score(df, *suffix_lm.learned(df)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)
    assert min(got.values()) > 30 * math.log10(1 / 2) - 10  # a bit for each word's first letter, next to nothing for its digit


def test_a_level_checks_two_filters_however_long_its_contexts(monkeypatch):
    """The contexts of any length are found from the bytes before, not by a walk through all shorter ones."""
    texts = [b"the then there hen", b"", b"zz", "then thé there hen the then".encode()] * 2
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, length, doc = textvec.words(data, offs)
    s = suffix_lm.stream(data, offs, start, length, doc)
    line = s.data.tobytes()
    calls = []
    passes = suffix_lm._passes
    monkeypatch.setattr(suffix_lm, "_passes", lambda *a: calls.append(1) or passes(*a))
    filters = [np.full(1 << 7, 255, np.uint8)]  # lets all through
    for d in range(suffix_lm.FIRST + 1, 15):
        calls.clear()
        which, context, gram, up = s.open_at(filters)
        assert len(calls) <= 2
        at, floor = s.at[which], s.floor[which]
        assert len(which) == sum(b"\n" not in line[max(0, a - d + 1):a] for a in s.at)  # at most the first byte is the line feed before a text
        for keys, back, behind in ((context, d, 0), (gram, d, 1), (up, d - 1, 1)):
            seen = [line[a - back:a + behind] for a in at]
            assert len(set(zip(seen, keys.tolist()))) == len(set(seen)) == len(set(keys.tolist()))
        assert (at - d >= floor).all()
        *_, (n, w, c, g) = s.longer(filters)
        assert n == d and (w == which).all() and (c == context).all() and (g == gram).all()
        filters.append(filters[0])
    closed = [*filters[:-1], np.zeros(1 << 7, np.uint8)]
    assert all(len(x) == 0 for x in s.open_at(closed))


def test_partial_counts_are_of_equal_keys(monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**64, 50, dtype=np.uint64)[rng.integers(0, 50, 5000)]
    for small in (False, True):
        keys = keys % np.uint64(40) if small else keys
        part = suffix_lm._Counts(1, ("ctx",))
        assert [*part.add(keys, keys * np.uint64(3))] == [*part.add(keys[:0], keys[:0])] == []
        batch, = part.flush()
        got = sorted(zip(*(batch.column(c).to_numpy().astype(np.uint64).tolist() for c in ("key", "n", "ctx"))))
        assert got == sorted((int(k), int(n), 3 * int(k) % 2**64) for k, n in zip(*np.unique(keys, return_counts=True)))
        wanted = np.append(keys, keys[:1] + np.uint64(1))
        known = np.unique(keys[::2])
        assert (suffix_lm._find(known, known % np.uint64(7), wanted, 99) == np.where(np.isin(wanted, known), wanted % np.uint64(7), 99)).all()


# -- 7 n-gram Jaccard join -------------------------------------------------------

def brute_components(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[root(i)] = root(j)
    low = {}
    for i, (k, a) in enumerate(sets):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(str((k, len(a), low.get(root(i), k) if a else k)) for i, (k, a) in enumerate(sets))


def near_copies(n, length, edits, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for e in rng.integers(0, length, edits):
            w[e] = f"e{i}x{e}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(docs_of, edge, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 7)
    mixed = near_copies(40, 80, 1) + near_copies(40, 80, 3, 5) + near_copies(30, 300, 9, 6) + ["a b c", "A B C", "a b c d", "", None, "x"]
    for df in (docs_of(mixed), edge, empty(edge)):
        got = jaccard_join.linked(df).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute_components(pairs_of(df))


def test_common_and_hot_shingles_change_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON_FROM", 1)
    monkeypatch.setattr(jaccard_join, "HOT_FROM", 3)
    df = docs_of(near_copies(50, 120, 2) + near_copies(20, 120, 5, 8))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.linked(df).collect()) == brute_components(pairs_of(df))


@pytest.mark.parametrize("heap", [0, 10**9])
def test_t_occurrence_search(heap, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAP_ITEMS", heap)
    rng = np.random.default_rng(2)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
        query = sets[0]
        need = rng.integers(1, 30, 12)
        able = rng.random(12) < 0.8
        want = [i for i, s in enumerate(sets) if able[i] and len(np.intersect1d(s, query)) >= need[i]]
        assert jaccard_join.Index(sets).search(query, need, able).tolist() == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


# -- 8 byte-level BPE -------------------------------------------------------------

def test_bpe_is_tiktoken_and_round_trips(edge, sample):
    want = tik(MULTI)
    for df in (edge, sample):
        ids = {t: np.array(want.encode_ordinary(t or ""), "<u4").tobytes() for _, t in pairs_of(df)}
        expect = sorted((str(k), len(ids[t]) // 4, hashlib.sha256(ids[t]).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in pairs_of(df))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(df, MULTI, P.PATTERN).collect()) == expect
    assert byte_bpe.round_trip(empty(edge), MULTI, P.PATTERN).collect() == []


def test_rank_queue_pops_in_order():
    q = byte_bpe.RankQueue(5000)
    rng = np.random.default_rng(3)
    ranks = rng.integers(0, 5000, 400)
    q.push_all(ranks, np.arange(400))
    seen = []
    while (got := q.pop()) is not None:
        seen.append(got[0])
        assert sorted(got[1].tolist()) == np.flatnonzero(ranks == got[0]).tolist()
    assert seen == sorted(set(ranks.tolist()))


# -- 9 sharding ----------------------------------------------------------------------

def test_shards_are_balanced_and_slots_gapless(docs_of, edge, sample):
    hot = ["h" * 60] * 900 + [f"t{i} " * (i % 40) for i in range(1800)]
    for df, spread in ((docs_of(hot), 1.05), (edge, None), (sample, None)):
        out = sharding.digest(df).collect()
        rows = pairs_of(df)
        assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in out) == sorted(
            str((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for k, t in rows)
        slots, size = collections.defaultdict(list), collections.Counter()
        for r in out:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        if spread:
            assert max(size.values()) <= spread * sum(size.values()) / 16
    assert sharding.digest(empty(edge)).collect() == []


# -- 10 language ID -----------------------------------------------------------------

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = langid.BiGRU(3, hidden=3)
    for k in model.w:
        model.w[k] = model.w[k].astype(np.float64)
    seq, label = rng.choice(np.frombuffer(b"abcd ", np.uint8), (6, 4)), np.array([0, 1, 2, 1])

    def loss():
        p, at = model.probabilities(model.states(seq)), langid._LETTER[seq]
        return -np.log(p[:, np.arange(4), label])[at].sum() / at.sum()

    grad = model.gradients(seq, label)
    for name in ("u", "o", "b", "x"):
        w = model.w[name]
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(5)] + ([(0, 97, 1), (1, 98, 5)] if name == "x" else []):
            old, e = w[at], 1e-2
            w[at] = old + e
            up = loss()
            w[at] = old - e
            down = loss()
            w[at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(edge):
    for df in (edge, edge.where("lang = 'en'"), edge.where("lang IS NULL"), empty(edge)):
        rows = [(str(r.doc_id), r.text) for r in df.collect()]
        got = [(str(r.doc_id), r.lang_pred) for r in langid.identified(df).collect()]
        assert sorted(k for k, _ in got) == sorted(k for k, _ in rows)
        blank = {k for k, t in rows if not any(c.isalpha() for c in t or "")}
        assert all(p == "und" for k, p in got if k in blank)


# -- registration and pipeline -----------------------------------------------------------

def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_pipeline_stages_follow_their_rules(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == cp.COLUMNS
        out = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in out.collect()}
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        if name == "quality_rules":
            led = quality.judged(kept).where("kept").collect()
            assert ids == {r.doc_id for r in led}
        if name == "near_duplicates":
            assert ids == {eval(x)[2] for x in brute_components(rows)}
        kept = out
    last = cp.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept.collect()}
    run = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.run(spark, SF).collect())
    assert run == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in last)


def test_pipeline_stages_take_edge_rows(spark, edge):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        stage(spark, empty(edge), SF).collect()
        out = stage(spark, edge, SF).collect()
        if name == "near_duplicates":  # 5, 6 (twice) and 7 have the same shingles
            assert sorted(str(r.doc_id) for r in out) == sorted(map(str, [1, 2, 3, 4, 5, 8, 9, None]))
