"""Packed series that meet in pairs against plain NumPy."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.operators import graph as G
from tidepanel.operators import series as S

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Forward filled prices with lives of their own over two slices of hours, one flat market, one too short; markets without an id count for nothing."""
    rng = np.random.default_rng(8)
    x = np.full((1500, 30), np.nan)
    for m in range(30):
        a, b = sorted(rng.choice(1500, 2, replace=False)) if m else (0, 3)
        x[a:b + 1, m] = 0.4 if m == 1 else np.repeat(rng.random(300), 5)[:b + 1 - a]
    rows = [(DAY + dt.timedelta(hours=t), 7 * m, float(x[t, m])) for t in range(1500) for m in range(30) if not np.isnan(x[t, m])]
    cells = spark.createDataFrame([*rows, (DAY, None, 0.5)], "ts timestamp_ntz, market_id bigint, p double")
    want = {}
    for i in range(30):
        for j in range(i + 1, 30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            r = None if len(a) < 2 or a.min() == a.max() or b.min() == b.max() else float(np.corrcoef(a, b)[0, 1])
            want[7 * i, 7 * j] = (int(both.sum()), r, float(a @ b), int((~np.isnan(x[:, i]) | ~np.isnan(x[:, j])).sum()))
    return cells, want


@pytest.mark.parametrize(("bins", "left"), [(1 << 14, 1 << 22), (4, 1), (2, 10)])
def test_mean_and_median_of_strength_without_a_table_of_pairs(panel, monkeypatch, bins, left):
    cells, want = panel
    strong = [abs(r) for n, r, *_ in want.values() if n >= 6 and r is not None]
    if left > 10:
        monkeypatch.setattr(G, "pair_sums", None)
        monkeypatch.setattr(S, "pairs", None)
        got = G.correlation_summary(cells, 6).first()
    else:
        got = S.strength_summary(S.packed(cells, []), 6, bins, left).first()
    assert got.pairs == len(strong) and abs(got.mean_abs_corr - np.mean(strong)) < 1e-9 and abs(got.median_abs_corr - np.median(strong)) < 1e-9


def test_no_pair_has_a_strength(spark):
    cells = spark.createDataFrame([(DAY, 1, 0.5), (DAY, 2, 0.5)], "ts timestamp_ntz, market_id bigint, p double")
    for few in (cells, cells.where("market_id = 1"), cells.where("false")):
        assert tuple(G.correlation_summary(few, 1).first()) == (None, 0, None)


def test_a_market_is_dealt_as_a_row_for_a_thousand_hours(panel):
    cells, _ = panel
    assert S.packed(cells, []).count() <= 3 * 30


@pytest.mark.parametrize("blocks", [None, 3])
def test_every_pair_once(panel, monkeypatch, blocks):
    cells, want = panel
    monkeypatch.setattr(G, "pair_sums", None)
    got = {(r.a, r.b): r for r in G.correlations(cells, min_hours=6, blocks=blocks).collect()}
    assert got.keys() == {p for p, (n, *_) in want.items() if n >= 6}
    assert all(r.n == want[p][0] and (r.r is None) == (want[p][1] is None) and abs((r.r or 0) - (want[p][1] or 0)) < 1e-9 for p, r in got.items())
    shared = {p: v for p, v in want.items() if v[0]}
    dots = {(r.a, r.b): (r.n, r.dot) for r in S.dots(S.packed(cells, []), blocks).collect()}
    assert dots.keys() == shared.keys() and all(dots[p][0] == v[0] and abs(dots[p][1] - v[2]) < 1e-9 for p, v in shared.items())
    overlap = {(r.a, r.b): r.overlap for r in G.jaccard(cells, blocks).collect()}
    assert overlap.keys() == shared.keys() and all(abs(overlap[p] - v[0] / v[3]) < 1e-12 for p, v in shared.items())
