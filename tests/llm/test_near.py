import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import near as D
from tidepanel.llm.queries import QUERIES


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain(rows, words, percent=80):
    """doc_id, set size, component and kept of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t, words) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                common[a, b] += 1
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return [(i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def hard_rows():
    """A chain, a hub whose copies are too far from each other, a large bucket of distinct near copies, and a passage many share."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, base = [], [word() for _ in range(300)]
    chain = base
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 5)
    hub = [word() for _ in range(240)]
    rows += [" ".join(edited(rng, hub, 10)) for _ in range(40)] + [" ".join(hub)]
    many = [word() for _ in range(200)]
    rows += [" ".join(edited(rng, many, rng.randint(1, 4))) for _ in range(120)]
    passage = [word() for _ in range(120)]
    rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(80)]
    rows += [rows[0], rows[-1]] * 6
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_hard_groups(corpus):
    rows = hard_rows()
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    assert ordered(D.near_groups(docs).collect()) == ordered(plain(rows, 5))


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_blocks_join_what_is_linked(corpus, monkeypatch, block):
    """Members of one bucket, dealt to one or to many blocks, each pair told by the first band it shares."""
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, " ".join(edited(rng, [f"p{i // 4}-{j}" for j in range(100)], 1))) for i in range(120)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    search = D.Search(docs, D.Settings())
    found = search.rest(search.apart(D.components(corpus.createDataFrame([], "a long, b long"))))
    ids = {r.cls: r.doc_id for r in search.members.collect()}
    got = {ids[r.cls]: ids[r.comp] // 4 for r in D.components(found).collect()}
    assert got == {i: i // 4 for i in range(120) if i % 4}


def test_edges(edges):
    rows = [(i, t) for i, t, *_ in EDGES]
    assert ordered(D.near_groups(edges).collect()) == ordered(plain(rows, 5))
    kept = D.keep_one(edges)
    assert kept.columns == edges.columns
    empty = [i for i, n, _, _ in plain(rows, 5) if not n]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*empty, *{c for _, n, c, _ in plain(rows, 5) if n}], key=str)
    assert D.near_groups(edges.limit(0)).count() == 0


@pytest.mark.parametrize("from_files", [False, True])
def test_one_row_of_each_component_stays(corpus, tmp_path, from_files):
    """An id met twice, once as a near copy and once alone; near copies without ids; repeated rows."""
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    lone = " ".join(f"u{i}" for i in range(60))
    rows = [(1, " ".join(base)), (2, near), (2, other), (None, lone), (None, lone + " y"), (None, lone), (3, ""), (3, ""), (None, None)]
    corpus.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(7)).write.parquet(f"{tmp_path}/d")
    kept = D.keep_one(corpus.read.parquet(f"{tmp_path}/d"), from_files=from_files)
    assert kept.columns == ["doc_id", "text", "row"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got in [sorted([(1, " ".join(base)), (2, other), (None, t), (3, ""), (3, ""), (None, None)], key=str) for t in (lone, lone + " y")]


def test_a_third_of_the_rows_in_one_class(corpus):
    rng = random.Random(4)
    hot = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(hot)) for i in range(0, 1200, 3)] + [(i, " ".join(edited(rng, hot, 1))) for i in range(1, 1200, 3)]
    rows += [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(2, 1200, 3)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    assert ordered(D.near_groups(docs, D.Settings(words=4)).collect()) == ordered(plain(rows, 4))


def test_query(corpus):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in corpus.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ordered(QUERIES["op5_near_dedup"](corpus, sf).collect()) == ordered(plain(rows, 4))


@pytest.mark.parametrize("edges_of", ["path", "random", "star"])
def test_components(corpus, edges_of):
    rng = random.Random(2)
    n = 60
    pairs = {"path": [(i, i + 1) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "star": [(0, i) for i in range(1, n)]}[edges_of]
    label = list(range(n + 1))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.cls: r.comp for r in D.components(corpus.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: label[x] for p in pairs for x in p if label[x] != x}


def test_sets_do_not_depend_on_segments(monkeypatch):
    texts = ["Aa bB  c", "", "one two three four five six seven", "x" * 50 + " y z\tw\x0bv", " lead and trail "]
    whole = D.shingle_sets(texts, 4)
    assert [len(s) for s in whole] == [len(shingles(t, 4)) for t in texts]
    monkeypatch.setattr(D, "SEGMENT", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, D.shingle_sets(texts, 4)))
