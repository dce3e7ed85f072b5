import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import neighbours as N
from tidepanel.llm.queries import QUERIES


def plain(rows, k=10, every=100):
    """The k nearest of each query by comparing it with every other usable vector."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    ids, data = np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float64)
    out = {}
    for i, v in good:
        if i % every == 0:
            far = np.sqrt(((data - np.array(v)) ** 2).sum(axis=1))
            out[i] = [(float(far[j]), int(ids[j])) for j in np.lexsort((ids, far)) if ids[j] != i][:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(corpus, sf):
    rows = corpus.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain([(r.vec_id, r.embedding) for r in rows])
    got = by_query(QUERIES["op8_neighbours"](corpus, f"/root/testdata/{sf}").collect())
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    exact = {q: dict((i, s) for s, i in plain_rows) for q, plain_rows in want.items()}
    assert all(abs(exact[q][i] - s) < 1e-9 for q in got for s, i in got[q] if i in exact[q])


def test_many_shards_and_blocks(corpus):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 24))
    data = [(int(i), (centres[i % 12] + 0.3 * rng.standard_normal(24)).tolist()) for i in range(900)]
    df = corpus.createDataFrame(data, "vec_id long, embedding array<double>")
    got = by_query(N.search(df, F.col("vec_id") % 20 == 0, settings=N.Settings(least=120, shard_rows=250, block_rows=10)).collect())
    want = plain(data, every=20)
    assert set(got) == set(want)
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_edges(corpus):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]),
            (6, [1.0, 2.0]), (None, [1.0, 1.0]), (300, [0.0, 0.0]), (7, [1.0, 0.5]), (8, []), *[(1000 + i, [3.0, 3.0]) for i in range(40)]]
    df = corpus.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS key", "2 AS ids", "3 AS shard", "4 AS rank", "5 AS score")
    got = by_query(N.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == plain(data)
    assert N.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert N.search(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_radius_holds_every_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 8, (400, 3)).astype(np.int64)
    tables = N.Tables(codes, 8)
    for query in codes[:20]:
        far = sum(np.vectorize(lambda x: bin(x).count("1"))(codes[:, k] ^ query[k]) for k in range(3))
        found = tables.within(query, 60)
        assert len(found) >= 60 and len(set(found.tolist())) == len(found)
        radius = far[found].max()
        assert set(np.flatnonzero(far < radius)) <= set(found.tolist())
        assert len(tables.within(query, 10_000)) == 400
