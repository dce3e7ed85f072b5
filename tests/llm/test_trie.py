import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import trie as E
from tidepanel.llm.common import remainder
from tidepanel.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered_turns(rows):
    """Turns (role, text) of each conversation: null turns first, equal turns in the order of their symbols."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            symbol = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, symbol, (role, text)))
    return {c: [t[3] for t in sorted(found)] for c, found in turns.items()}


def rebuilt(rows):
    turns = ordered_turns(rows)
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: turns.get(c - c % 5, [])[:head(c)] + own[head(c):] for c, own in turns.items()}


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(found), len(p), min(members[p[:-1]]) if p else None, len(found), kids[p], leaves[p], saved[p], digest(p)) for p, found in members.items()), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(corpus, rows):
    return corpus.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("key", F.lit("x")).withColumn("n", F.lit(2))


def by_operator(corpus, rows):
    c = F.col("conv_id")
    return got(E.prefix_trie(E.grafted(E.sequences(table(corpus, rows)), c - c % 5, remainder(c, 9), 8)))


def random_rows(seed, convs=150):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", None, "longer text"])))
    return rows


@pytest.mark.parametrize("symbols,convs", [(1 << 18, 1 << 16), (1, 1 << 16), (7, 3), (40, 1)])
def test_pieces_of_any_size(corpus, monkeypatch, symbols, convs):
    monkeypatch.setattr(E, "PIECE_SYMBOLS", symbols)
    monkeypatch.setattr(E, "PIECE_SEQUENCES", convs)
    rows = random_rows(5)
    assert by_operator(corpus, rows) == plain(rebuilt(rows))


def test_edges(corpus):
    rows = [(1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"), (1, 0, None, None), (2, 5, "", ""), (2, 5, None, None),
            (7, 1, "user", "x" * 300_000), (8, 1, "user", "x" * 300_000), (None, 1, "user", "nobody's"), (1000, 1, "user", "a\nb"), (1001, 1, "user\na", "b")]
    rows += [(20, t, "user", str(t % 7)) for t in range(150)] + [(21, t, "user", str(t % 7)) for t in range(149)]
    assert by_operator(corpus, rows) == plain(rebuilt(rows))
    assert by_operator(corpus, []) == []
    assert by_operator(corpus, [(None, 1, "user", "x")]) == []


def test_large_group_of_copies(corpus, monkeypatch):
    """A third of the conversations are equal, most share their first turn, and one holds a third of the turns."""
    monkeypatch.setattr(E, "PIECE_SEQUENCES", 16)
    rng = random.Random(8)
    rows = [(c, t, "user", f"same{t}") for c in range(0, 300, 3) for t in range(4)]
    rows += [(c, t, "user", "same0" if t == 0 else str(rng.randrange(3))) for c in range(1, 300, 3) for t in range(5)]
    rows += [(2, t, "user", f"turn{t % 3}") for t in range(60)]
    assert by_operator(corpus, rows) == plain(rebuilt(rows))
    assert got(E.prefix_trie(E.sequences(table(corpus, rows)))) == plain(ordered_turns(rows))


def test_extents_against_scan():
    rng = np.random.default_rng(4)
    values = rng.integers(-1, 5, 100)
    levels = E.sparse_table(values)
    at, depth = rng.integers(0, 100, 500), rng.integers(0, 5, 500)
    lo, hi = E.left_extent(levels, at, depth), E.right_extent(levels, at, depth)
    for a, d, left, right in zip(at, depth, lo, hi):
        assert (values[left + 1:a + 1] >= d).all() and (left == 0 or values[left] < d)
        assert (values[a + 1:right + 1] >= d).all() and (right == 99 or values[right + 1] < d)
    assert (E.range_minimum(levels, lo, hi) == [values[a:b + 1].min() for a, b in zip(lo, hi)]).all()


def test_query(corpus):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in corpus.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](corpus, sf)) == plain(rebuilt(rows))
