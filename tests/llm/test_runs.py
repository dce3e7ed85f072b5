import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import runs as R
from tidepanel.llm.queries import QUERIES

BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANK.split((text or "").encode()) if w]


def plain(words, least_words=6, least_exponent=4):
    """Maximal stretches of each period, those with a smaller period left out."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least_words, least_exponent * q) and (i, length) not in seen:
                seen.add((i, length))
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(b):
    return hashlib.sha256(b).hexdigest()


def expected(doc_id, text):
    """The row of the query for one document."""
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n:
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if rest == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_random_words_against_scan():
    rng = random.Random(1)
    batch = []
    for size in (2, 2, 2, 3, 5):
        for _ in range(120):
            text = [b"%d" % rng.randrange(size) for _ in range(rng.randrange(60))]
            for _ in range(rng.randrange(3)):
                at, q = rng.randrange(len(text) + 1), rng.randrange(1, 6)
                text[at:at] = (text[at:at + q] or [b"z"]) * rng.randrange(1, 9)
            batch.append(text)
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    batch += [fib[1], [b"x"] * 500, [b"x", b"y"] * 300, ([b"x"] * 9 + [b"y"]) * 40, [], [b"one"], [b"t", b"u"] * 3, [b"t"] * 6]
    assert R.runs_of(batch, 6, 4) == [plain(t) for t in batch]
    assert R.runs_of(batch, 2, 2) == [plain(t, 2, 2) for t in batch]


@pytest.mark.parametrize("tests", [1, 50])
def test_slices_do_not_matter(corpus, monkeypatch, tests):
    monkeypatch.setattr(R, "SLICE", tests)
    monkeypatch.setattr(R, "TESTS", tests)
    texts = ["a b a b a b a b", None, "", "no repeats here", "x " * 30, "y x " * 40 + "y"]
    got = R.periodic_runs(corpus.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.row.doc_id: [tuple(x) for x in r.runs] for r in got} == {i: plain(words_of(t)) for i, t in enumerate(texts)}


def test_long_period_text():
    words = [b"%d" % (i % 5000) for i in range(30_000)]
    assert R.runs_of([words], 6, 4) == [[(0, 30_000, 5000)]]
    assert R.collapsed(words, [(0, 30_000, 5000)]) == b" ".join(words[:5000])


def test_edges(edges):
    found = R.periodic_runs(edges).collect()
    by_id = {r.row.doc_id: [tuple(x) for x in r.runs] for r in found}
    assert by_id[7] == [(0, 44_000, 11)] and by_id[3] == by_id[4] == by_id[5] == by_id[11] == []
    assert R.periodic_runs(edges.limit(0)).count() == 0
    assert found[0].row.asDict().keys() == set(edges.columns)


def test_query(corpus):
    sf = "/root/testdata/sf0.001"
    rows = corpus.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_runs"](corpus, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(expected(*r) for r in rows)


def test_query_on_edges(corpus, edges, tmp_path):
    rows = [(i, t if len(t or "") < 9999 else t[:520]) for i, t, *_ in EDGES] + [(i, "some words that come and go " * 4) for i in range(100, 160)]
    corpus.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_runs"](corpus, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
