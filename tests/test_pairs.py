import datetime as dt

import numpy as np
import pytest

from tidepanel.operators import pairs as R

DAY = dt.datetime(2024, 1, 1)


def panel(spark, markets=40, hours=300, gaps=0.2, seed=4):
    """Prices of two keys that share factors; some series are flat, some have gaps."""
    rng = np.random.default_rng(seed)
    x = 0.5 + 0.1 * np.cumsum(rng.normal(size=(hours, 6)), axis=0) @ rng.normal(size=(6, markets)) / 10 + 0.02 * rng.normal(size=(hours, markets))
    x[:, 3] = 0.4
    seen = rng.random(x.shape) >= gaps
    rows = [(k, DAY + dt.timedelta(hours=t), 100 + m, float(x[t, m] * k)) for k in (1, 2) for t in range(hours) for m in range(markets) if seen[t, m]]
    return spark.createDataFrame(rows, "k int, ts timestamp_ntz, market_id long, p double"), np.where(seen, x, np.nan)


def plain_r(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return None
    return float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize(("blocks", "slice_hours"), [(1, 1024), (3, 50)])
def test_strong_pairs_and_best_partners(spark, monkeypatch, blocks, slice_hours):
    monkeypatch.setattr(R, "SLICE_HOURS", slice_hours)
    cells, x = panel(spark)
    m = x.shape[1]
    r = {(i, j): plain_r(x, i, j) for i in range(m) for j in range(i + 1, m)}
    want = {(100 + i, 100 + j): v for (i, j), v in r.items() if v is not None and round(abs(v), 9) >= 0.3}
    got = R.strong_pairs(cells, ["k"], 0.3, blocks=blocks).collect()
    for k in (1, 2):
        told = {(g.a, g.b): g.r for g in got if g.k == k}
        assert told.keys() == want.keys() and all(abs(told[p] - want[p]) < 1e-9 for p in want)
    w = np.zeros((m, m))
    for (i, j), v in r.items():
        w[i, j] = w[j, i] = round(abs(v or 0.0), 9)
    top = {(t.owner, t.rank): t.member for t in R.top_correlated(cells, ["k"], 5, blocks=blocks).where("k = 2").collect()}
    for i in range(m):
        best = sorted((j for j in range(m) if j != i), key=lambda j: (-w[i, j], j))[:5]
        assert [top[100 + i, n + 1] for n in range(5)] == [100 + j for j in best]


@pytest.mark.parametrize(("blocks", "chunk"), [(1, 28), (2, 3)])
def test_sliding_windows_share_one_product(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(R, "CHUNK_SLICES", chunk)
    cells, x = panel(spark, markets=20, hours=240, gaps=0.0)
    cells = cells.where("k = 1").drop("k")
    first = int(DAY.replace(tzinfo=dt.timezone.utc).timestamp() // 3600)
    got = {(g.window_hours, g.window_end, g.a, g.b): g.r for g in R.sliding_pairs(cells, first, first + 239, (24, 72), 24, 0.3, blocks).collect()}
    want = {}
    for w in (24, 72):
        for end in range(w - 1, 240):
            if end % 24 == 0:
                part = x[end - w + 1:end + 1]
                for i in range(20):
                    for j in range(i + 1, 20):
                        v = plain_r(part, i, j)
                        if v is not None and round(abs(v), 9) >= 0.3:
                            want[w, DAY + dt.timedelta(hours=end), 100 + i, 100 + j] = v
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)
