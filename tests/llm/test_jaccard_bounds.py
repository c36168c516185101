"""The bounds that keep pairs and nodes from being read: sound for every linked pair, and tight on template pages."""

import random

import pytest
from test_operators import brute_components, pairs_of

from cohortlens.llm import jaccard_join


def test_linked_sets_share_enough_within_their_prefixes(spark):
    """Any order, many sizes: the prefixes of linked sets share at least what the pair bound asks, and each
    set's share reaches what the size range of a unit asks."""
    rng, rows = random.Random(1), []
    for _ in range(3000):
        n = rng.randrange(1, 120)
        a = rng.sample(range(400), n)
        keep = a[:max(1, n - rng.randrange(0, 1 + n // 3))]
        b = list(set(keep) | set(rng.sample(range(400, 800), rng.randrange(0, 1 + n // 4))))
        both = len(set(a) & set(b))
        if 100 * both < 75 * len(set(a) | set(b)):
            continue
        rank = {x: i for i, x in enumerate(rng.sample(range(800), 800))}
        pre = [set(sorted(s, key=rank.get)[:jaccard_join.prefix_length(len(s))]) for s in (a, b)]
        rows.append((len(a), len(b), len(pre[0] & pre[1])))
    assert len(rows) > 500
    df = spark.createDataFrame(rows, "n long, m long, s long")
    assert df.where(f"s < {jaccard_join._short_of('n', 'm', 75)}").count() == 0
    # one unit a row, with strangers of other sizes around the two
    members = []
    for u, (n, m, s) in enumerate(rows):
        members += [(u, 2 * u, n, s), (u, 2 * u + 1, m, s), (u, -u - 1, max(1, min(n, m) - rng.randrange(30)), 0), (u, -u - 10**6, max(n, m) + rng.randrange(30), 0)]
    kept = {(r.unit, r.node) for r in jaccard_join._reachable(spark.createDataFrame(members, "unit long, node long, n long, w long"), 75).collect()}
    assert all((u, 2 * u + k) in kept for u in range(len(rows)) for k in (0, 1))


@pytest.fixture
def read_rows(monkeypatch):
    """How many rows of blocks are searched."""
    seen, plain = [], jaccard_join._searched

    def counting(docs, members, percent):
        seen.append(members.count())
        return plain(docs, members, percent)

    monkeypatch.setattr(jaccard_join, "_searched", counting)
    return seen


def pages(n, same, own, own_words):
    rng = random.Random(n)
    head = " ".join(f"t{i}" for i in range(same))
    return [head + " " + " ".join(f"d{i}w{rng.randrange(own_words)}" for _ in range(own)) for i in range(n)]


@pytest.mark.parametrize("n", [500, 1500])
def test_template_pages_without_links_are_not_searched(docs_of, read_rows, n):
    """Pages that share 290 words of 385: no pair links; no block of them is read, however many there are."""
    got = jaccard_join.linked(docs_of(pages(n, 290, 95, 10**9))).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert sum(read_rows) <= n


def test_templates_and_copies_match_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 9)
    rng = random.Random(5)
    texts = pages(40, 120, 20, 30) + pages(40, 60, 60, 10**9)
    for t in texts[:30] + texts[50:60]:
        w = t.split()
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w[:len(w) - rng.randrange(12)]))
    df = docs_of(texts)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.linked(df).collect()) == brute_components(pairs_of(df))
