import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import exact as X


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_edges(edges):
    assert ordered(X.exact_groups(edges).collect()) == ordered(plain([(i, t) for i, t, *_ in EDGES]))
    assert X.exact_groups(edges.limit(0)).count() == 0


def test_spilling_gives_the_same(corpus):
    docs = corpus.range(600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a hot text " * 20).otherwise(F.concat(F.lit("text "), F.repeat(F.md5((F.col("id") % 150).cast("string")), 9))).alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for budget in (1 << 20, 6000, 300):
        assert ordered(X.exact_groups(docs, budget=budget).collect()) == ordered(plain(rows))


def test_kept_rows_have_all_columns(edges):
    kept = X.keep_first(edges)
    assert kept.columns == edges.columns
    got = sorted(((r.doc_id, r.source) for r in kept.collect()), key=str)
    assert len(got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in EDGES})
    assert (1, "src0") in got and (2, "src1") not in got and got.count((9, "other")) == 1
