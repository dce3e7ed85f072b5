import random

from hypothesis import given, settings
from hypothesis import strategies as st

import check
from tests.llm.conftest import EDGES
from tidepanel.llm import lines as L
from tidepanel.llm.queries import ORACLE, QUERIES

BLANKS = " \t\r\f\x0b"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain(rows, near):
    first = {}
    place = lambda i, k: (i is None, i or 0, k)
    split = [(i, [x.strip(BLANKS) for x in (t or "").split("\n")]) for i, t in rows]
    for i, ls in split:
        for k, x in enumerate(ls):
            if x:
                first[x] = min(first.get(x, (True, 0, 0)) if x in first else place(i, k), place(i, k))
    long = [x for x in first if len(x) >= near]
    late = {b for a in long for b in long if a != b and first[a] < first[b] and one_edit(a, b)}
    out = []
    for i, ls in split:
        exact = [k for k, x in enumerate(ls) if x and first[x] < place(i, k)]
        close = [k for k, x in enumerate(ls) if x in late and k not in exact]
        out.append((i, len(ls), len(exact), len(close), sorted(exact + close)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_near_lines(corpus):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdeé ", k=rng.randint(8, 40))) for _ in range(40)]
    rows = []
    for i in range(60):
        picked = []
        for _ in range(5):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(x))
                x[k:k + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            picked.append("".join(x))
        rows.append((i, "\n".join(picked)))
    docs = corpus.createDataFrame(rows, "doc_id long, text string")
    got = ordered(L.line_duplicates(docs, near_chars=10).select("doc_id", "n_lines", "n_exact", "n_near", "removed").collect())
    want = ordered(plain(rows, 10))
    assert sum(r[3] for r in want) > 50
    assert got == want


def test_edges(edges):
    got = L.line_duplicates(edges).select("doc_id", "n_lines", "n_exact", "n_near", "removed").collect()
    assert ordered(got) == ordered(plain([(i, t) for i, t, *_ in EDGES], L.NEAR_CHARS))
    cleaned = L.clean(edges)
    assert cleaned.columns == edges.columns and cleaned.count() == len(EDGES)
    told = {r.doc_id: r.text for r in cleaned.collect()}
    assert told[8].endswith("!") and told[10] == "" and told[12] == "" and told[7] == dict((i, t) for i, t, *_ in EDGES)[7]
    assert L.line_duplicates(edges.limit(0)).count() == 0


def test_query_equals_sql(corpus):
    sf = "/root/testdata/sf0.001"
    status, note = check.compare(corpus, check.connect(sf), "op7_line_dedup", QUERIES["op7_line_dedup"], ORACLE["op7_line_dedup"], sf)
    assert status == "ok", note


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=8))
def test_variants(line):
    every = lambda s: [int(k) for _, keys in L.variant_slices(s) for k in keys]
    hashes, whole = every(line), lambda s: every(s)[-1]
    assert len(hashes) == len(line) + 1
    assert [whole(line[:i] + line[i + 1:]) for i in range(len(line))] == hashes[:-1]
    assert len({int(h) for h in hashes}) == len({line, *(line[:i] + line[i + 1:] for i in range(len(line)))})


def shortened(line):
    """Every variant's hash by the plain sum: letter values times powers of their place, for the line and for it less each code point."""
    base, salt, full = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (1 << 64) - 1

    def value(c):
        v = ((ord(c) + salt) & full) * 0xBF58476D1CE4E5B9 & full
        v = (v ^ v >> 29) * 0x94D049BB133111EB & full
        return v ^ v >> 32

    def told(x):
        h = (sum(value(c) * pow(base, i, 1 << 64) for i, c in enumerate(x)) * salt + len(x)) & full
        return h - (1 << 64) if h >> 63 else h

    return {-1: told(line), **{i: told(line[:i] + line[i + 1:]) for i in range(len(line))}}


def test_variants_by_slices(monkeypatch):
    lines = ["", "a", "ab\U0001f600é", "aaaa bbbb\ud800 cccc", "x" * 16, "0123456789" * 5]
    for size in (1, 4, 16, L.SLICE):
        monkeypatch.setattr(L, "_POWERS", L._POWERS[:size])
        monkeypatch.setattr(L, "SLICE", size)
        for line in lines:
            got = [(int(p), int(k)) for places, keys in L.variant_slices(line) for p, k in zip(places, keys)]
            assert dict(got) == shortened(line) and len(got) == len(line) + 1
        monkeypatch.undo()


def test_memory_of_a_very_long_line():
    import tracemalloc

    line = "abcdefghij" * 2_000_000
    tracemalloc.start()
    n = sum(len(keys) for _, keys in L.variant_slices(line))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(line) + 1 and peak < 8 << 20


def test_a_line_that_fills_a_third_of_all_rows(corpus):
    common = "this line is in nearly every document of all"
    rows = [(i, f"{common}\nline number {i} of its own kind here\n\n\n{common[:-1]}" if i % 3 else common) for i in range(600)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = ordered(L.line_duplicates(docs).select("doc_id", "n_lines", "n_exact", "n_near", "removed").collect())
    assert got == ordered(plain(rows, L.NEAR_CHARS))
