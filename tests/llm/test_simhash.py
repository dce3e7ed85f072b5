import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import simhash as H
from tidepanel.llm.queries import QUERIES


def plain_fingerprint(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    wide = min(words, len(found))
    hashes = [xxhash.xxh64(b" ".join(found[i:i + wide]), seed=42).intdigest() for i in range(len(found) - wide + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=4):
    """The component of each fingerprint, by comparing all pairs."""
    nodes = sorted(set(nodes))
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(nodes, np.uint64)
    for i, x in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius):
            parent[root(nodes[i + 1 + j])] = root(x)
    return {x: root(x) for x in nodes}


def plain(rows):
    """doc_id, fingerprint and component of each document."""
    fps = [plain_fingerprint(t) for _, t in rows]
    comp, least = plain_components(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fps)), key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def linked(corpus, nodes, settings=H.Settings()):
    """The components that the links of the operator join."""
    classes = corpus.createDataFrame([(signed(x),) for x in set(nodes)], "fp long")
    found = H.links(H.dealt_to_cells(classes, settings), settings.radius).collect()
    mask = (1 << 64) - 1
    assert all(bin((r.a ^ r.b) & mask).count("1") <= settings.radius and r.a != r.b for r in found)
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.a & mask)] = root(r.b & mask)
    return {x: root(x) for x in nodes}, len(found)


def same_partition(a, b):
    return len({(a[x], b[x]) for x in a}) == len(set(a.values())) == len(set(b.values()))


@pytest.mark.parametrize("block,pairs", [(1 << 13, 1 << 20), (20, 1 << 20), (60, 200)])
def test_links_join_all_that_is_near(corpus, monkeypatch, block, pairs):
    """Pairs at each distance around the radius, chains, a dense cluster and random fingerprints."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "PAIRS", pairs)
    rng = random.Random(6)
    nodes = [0, (1 << 64) - 1, 1 << 63, 1]
    for d in range(1, 8):
        for _ in range(60):
            x = rng.getrandbits(64)
            nodes += [x, flipped(rng, x, d)]
    x = rng.getrandbits(64)
    for _ in range(40):
        x = flipped(rng, x, 4)
        nodes.append(x)
    center = rng.getrandbits(64)
    nodes += [flipped(rng, center, rng.randrange(4)) for _ in range(400)]
    got, n = linked(corpus, nodes)
    assert same_partition(got, plain_components(nodes))


def test_dense_cluster_tells_few_links(corpus):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    nodes = [center, *(flipped(rng, center, rng.choice([1, 2, 2, 3])) for _ in range(3000))]
    got, n = linked(corpus, nodes)
    assert len(set(got.values())) == 1 and n < 40 * len(set(nodes))


@pytest.mark.parametrize("parts,segment,radius", [(3, 2, 4), (2, 4, 3), (1, 8, 2), (5, 1, 4)])
def test_cells_meet_all_near_pairs(parts, segment, radius):
    """Every pair within the radius has a cell where one is at home and the other at home or visiting; the embedding bounds from below."""
    settings = H.Settings(parts=parts, segment=segment, radius=radius)
    rng = random.Random(3)
    xs = [rng.getrandbits(64) for _ in range(100)]
    ys = [flipped(rng, x, rng.randrange(radius + 1)) for x in xs]
    fps = np.array(xs + ys, np.uint64)
    cell, who, home = H.cells(fps, settings)
    homes, there = [set() for _ in fps], [set() for _ in fps]
    for c, w, h in zip(cell.tolist(), who.tolist(), home.tolist()):
        there[w].add(c)
        if h:
            homes[w].add(c)
    for i in range(100):
        assert homes[i] & there[100 + i] or there[i] & homes[100 + i]
    counts = H.embedded(fps, settings)
    assert (np.abs(counts[:100] - counts[100:]).sum(axis=1) <= np.bitwise_count(fps[:100] ^ fps[100:])).all()


def test_edges(corpus, edges):
    rows = [(i, t) for i, t, *_ in EDGES]
    docs = edges.withColumn("fp", F.lit(1)).withColumn("size", F.lit(2)).withColumn("cell", F.lit(3))
    got = H.near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert H.near_groups(edges.limit(0)).count() == 0


def test_a_third_of_the_rows_in_one_class(corpus):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, "the same text in many rows of the table") for i in range(0, 1500, 3)]
    rows += [(i, " ".join(rng.choices(words, k=30))) for i in range(1, 1500, 3)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    got = H.near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_query(corpus):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in corpus.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_simhash"](corpus, sf).collect()), key=str) == plain(rows)
