"""Periodic runs, spelling variants and WARC archives against brute-force versions and on edge rows."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import periodic_runs, queries, spelling, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SF = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# -- 11 periodic runs ---------------------------------------------------------------

def brute_runs(w):
    found = {}
    ids = np.unique(w, return_inverse=True)[1] if len(w) else np.zeros(0, int)
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[0], ids[q:] == ids[:-q], [0]])
        step = np.diff(same)
        for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(key, w):
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def brute_digest(key, text):
    w = planted(key, WORDS.findall(text or ""))
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def random_words(rng):
    kinds, n = rng.choice([1, 2, 3, 5, 30, 1000]), rng.choice([0, 1, 10, 24, 30, 60, 200, 500])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            p, a = rng.randrange(1, rng.choice([2, 4, 9, 40])), rng.randrange(n)
            u = [rng.randrange(kinds) for _ in range(p)]
            for i in range(a, min(n, a + rng.randrange(1, 12 * p + 30))):
                w[i] = u[(i - a) % p]
    return w


def test_runs_of_random_blocks_match_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 12))]
        offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        start, end, period = periodic_runs.runs_of(np.array([x for d in docs for x in d], np.int64), offs)
        got = [[] for _ in docs]
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
            d = int(np.searchsorted(offs, s, side="right") - 1)
            got[d].append((s - int(offs[d]), e - s, q))
        assert got == [brute_runs(d) for d in docs]


def test_nested_and_square_rich_words():
    a, b = [0], [0, 1]
    while len(b) < 400:  # Fibonacci word: overlapping runs of many periods
        a, b = b, b + a
    for w in (b, b * 3, [0] * 3000, ([0] * 30 + [1]) * 20, [0, 1] * 12 + [0] + [1, 2, 3] * 9):
        start, end, period = periodic_runs.runs_of(np.array(w, np.int64), np.array([0, len(w)]))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(w)


def test_grammar_nodes_spell_their_words():
    rng = random.Random(1)
    w = np.array([rng.randrange(4) for _ in range(900)] * 2, np.int64)
    symbol, start, boundary, end = periodic_runs.derivation(w, np.array([0, 700, 700, 1800]), 2)
    spelled = {}
    for x, s, b, e in zip(symbol.tolist(), start.tolist(), boundary.tolist(), end.tolist(), strict=True):
        assert s < b < e and (e <= 700 or s >= 700)
        assert spelled.setdefault(x, (b - s, w[s:e].tolist())) == (b - s, w[s:e].tolist())
    assert len(spelled) < len(symbol)  # nonterminals that occur again are one symbol
    roots = {(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)}
    assert (0, 700) in roots and (700, 1800) in roots


def test_op11_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((brute_digest(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted_rows(queries.op11_periodic_runs(spark, SF)) == want
    assert any(r[1] for r in want)


def test_op11_edge_rows(edge):
    want = sorted((brute_digest(r.doc_id, r.text) for r in edge.collect()), key=repr)
    got = periodic_runs.digest(edge)
    assert sorted_rows(got) == want and got.columns == [f.split()[0] for f in periodic_runs.DIGEST.split(", ")]
    assert periodic_runs.digest(edge.limit(0)).count() == 0


def test_runs_and_collapsed_texts(docs_of):
    texts = ["x " + "a b " * 20 + "y", "", None, "one  two\nthree", "z " * 100]
    docs = docs_of(texts * 300)
    runs = periodic_runs.periodic_runs(docs)
    assert sorted_rows(runs.where("doc_id < 5")) == [(0, 1, 40, 2), (4, 0, 100, 1)] and runs.count() == 600
    texts = {r.doc_id: r.text for r in periodic_runs.collapsed(docs).collect()}
    assert [texts[i] for i in range(5)] == ["x a b y", "", "", "one two three", "z"] and len(texts) == 1500
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, 10)


# -- 12 spelling variants -----------------------------------------------------------

def brute_vocabulary(rows):
    n = collections.Counter()
    for key, text in rows:
        for run in LETTERS.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{key}:{w}".encode())
            if key is not None and h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_near(n):
    """By deletion neighbourhoods: words are near if one is the other less a code point, or both lose the same place."""
    place = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            place[w[:i], w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for ws in place.values():
        for w in ws:
            near[w] |= ws - {w}
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in n:
                near[w].add(v)
                near[v].add(w)
    return near


def brute_groups(n):
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_op12_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_groups(brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    assert sorted_rows(queries.op12_spelling_variants(spark, SF)) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


@pytest.mark.parametrize(("shard_rows", "hot_rows"), [(50, 5), (10_000, 10_000)])
def test_op12_splits_hot_groups(spark, docs_of, shard_rows, hot_rows):
    """Thousands of words that share a half, or all but one code point; chains of forms."""
    rng = random.Random(7)
    words = {"document" + "".join(rng.choice("abé") for _ in range(7)) for _ in range(900)}
    words |= {"abcdefg" + c + "hijklm" for c in "abcdefghijklmnopqrstuvwxyz"} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaa"}
    texts = [" ".join(sorted(words))] * 2 + ["colourful " * 1200, "colorful " * 110, "colrful " * 9, "Colrfuls colrfuls", "a" * 3000 + " " + "a" * 2999] * 2
    docs = docs_of(texts)
    want = brute_groups(brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    assert sorted_rows(spelling.grouped(docs, shard_rows=shard_rows, hot_rows=hot_rows)) == want
    chain = {r[0]: r for r in want}
    assert chain["colrfuls"][2] == "colourful" or chain["colrful"][2] == "colourful"


def test_op12_edge_rows(edge):
    want = brute_groups(brute_vocabulary([(r.doc_id, r.text) for r in edge.collect()]))
    assert sorted_rows(spelling.grouped(edge)) == want and want
    assert spelling.grouped(edge.limit(0)).collect() == []


def test_index_intervals_count_patterns():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(80)})
    shard = spelling.Shard(pa.array(words))
    text = "$" + "$".join(words) + "$"
    for w in words[:20]:
        match, at = shard.index.start(1), len(w) // 2
        lo = hi = at
        while lo > 0 or hi < len(w):  # grows to either side in turn
            right = hi < len(w) and (lo == 0 or rng.random() < 0.5)
            c = w[hi] if right else w[lo - 1]
            lo, hi = (lo, hi + 1) if right else (lo - 1, hi)
            match = shard.index.extend(match, np.array(["$abc".index(c)]), right)
            assert int(match[2][0]) == sum(text.startswith(w[lo:hi], i) for i in range(len(text)))


# -- 13 WARC -----------------------------------------------------------------------

def brute_archive(rows):
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        first = min(same) if len(b) >= 100 and same and page is not None else None
        revisit = first is not None and first != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None))
    return sorted(out, key=repr)


BIG = "é" * 30_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
PAGES = [(1, "http://a/", "p" * 150), (2, "http://b/ c\r\nX: y", "p" * 150), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", BIG), (8, "u", BIG),
         (None, "u", "p" * 150), (1, "u", "p" * 150), (2, "u", "q" * 200), (10, "z", "q" * 200), (10, "z", "q" * 200), (-5, "n", "\x00\x1f" * 60), (11, "e", "x" * 99), (12, "e", "x" * 99)]


def test_op13_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted_rows(queries.op13_warc(spark, SF)) == [r[:5] for r in brute_archive(rows)]


def test_op13_sql_matches_brute_force(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").toPandas()  # noqa: F841 (DuckDB reads it by name)
    assert sorted(duckdb.sql(warc.round_trip_sql()).fetchall(), key=repr) == [r[:5] for r in brute_archive(PAGES)]


def test_op13_edge_rows(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in PAGES], "page_id long, url string, html string, digest string, serial int")
    assert sorted_rows(warc.round_trip(pages)) == brute_archive(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_op13_large_group_of_copies(spark):
    pages = spark.range(0, 6000, 1, 4).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "if(id % 3 = 0, concat('c', id), repeat('copy ', 40)) AS html")
    got = warc.round_trip(pages)
    assert got.where("fault IS NOT NULL").count() == 0 and got.count() == 6000
    assert got.where("record_type = 'revisit' AND refers_to = 1 AND payload_bytes = 200").count() == 3999


def test_archives_keep_payloads_over_segments_and_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, segment=1000, archive_bytes=20_000)
    files = list((tmp_path / "a").rglob("*.gz"))
    assert len(files) > 3
    for f in files:
        for named, block in warc.records(gzip.decompress(f.read_bytes())):
            assert named["content-length"] == str(len(block)) <= "9999"
    got = {(r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert {(7, BIG.encode()), (1, b"p" * 150), (3, b""), (10, b"q" * 200)} - got == {(10, b"q" * 200)}


def test_faults_of_archives_are_named(spark, tmp_path):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world" * 30, 100)
    cut = [message[i:i + 100] for i in range(0, len(message), 100)]

    def parts(page, numbers, total, kind="response"):
        for k in numbers:
            head = [("WARC-Record-ID", f"<urn:x-page:{page}#0>")] if k == 1 else [("WARC-Segment-Origin-ID", f"<urn:x-page:{page}#0>")]
            last = [("WARC-Segment-Total-Length", str(total))] if k == len(cut) else []
            yield warc.record("response" if k == 1 else "continuation", [*head, ("WARC-Segment-Number", str(k)), *last], cut[k - 1])

    every = range(1, len(cut) + 1)
    whole = [r for page, numbers, total in [(1, [*every][::-1], len(message)), (2, [k for k in every if k != 2], len(message)), (3, every, 7), (4, [*every, 2], len(message))]
             for r in parts(page, numbers, total)]
    single = [warc.record("response", [("WARC-Record-ID", f"<urn:x-page:{p}#0>"), ("WARC-Payload-Digest", d)], b) for p, d, b in [
        (5, "sha256:00", message), (6, "", message[:-9]), (7, "", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"),
        (8, "", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2;x=1\r\nok\r\n0\r\nTrailer: a\r\n\r\n")]]
    lost = warc.record("revisit", [("WARC-Record-ID", "<urn:x-page:9#0>"), ("WARC-Refers-To", "<urn:x-page:99>"), ("WARC-Payload-Digest", "sha256:ab")], b"")
    (tmp_path / "x.warc").write_bytes(b"".join(whole[::2] + single))
    (tmp_path / "y.warc").write_bytes(b"".join([*whole[1::2], lost, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"]))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {p for p, r in got.items() if r.fault is None} == {1, 4, 7, 8}
    assert bytes(got[1].payload) == bytes(got[4].payload) == b"hello world" * 30 and bytes(got[8].payload) == bytes(got[7].payload) == b"ok"
    assert got[None].record_type == "broken" and "cut short" in got[None].fault and "segments" in got[2].fault and "bytes of 7" in got[3].fault


def test_chunked_framing_round_trip():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        body = random.Random(n).randbytes(n)
        assert warc.dechunked(warc.chunked(body)) == body
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n", b"0\r\n", b"0\r\n\r\nmore", b"-1\r\n\r\n"):
        with pytest.raises(warc.Fault):
            warc.dechunked(bad)
