"""Full scores of universes against plain NumPy."""

import numpy as np
import pytest

from tidepanel import fixtures as X
from tidepanel.operators import joins as J
from tidepanel.operators import panel as P
from tidepanel.operators import quality as Q
from tidepanel.plans.catalog import QUERIES
from tidepanel.plans.quality import LETTERS, SPECS, THRESHOLDS, pool

SF = "/root/testdata/sf0.01"


def components_for(wide, share):
    """Components of the standardised panel that reach a share of variance, missing hours at the mean."""
    wide = wide.loc[:, wide.min() < wide.max()]
    z = ((wide - wide.mean()) / wide.fillna(wide.mean()).std(ddof=0)).fillna(0.0).to_numpy()
    s = np.linalg.svd(z, compute_uv=False) ** 2
    return int(np.searchsorted(np.cumsum(s) / s.sum(), share) + 1)


def test_candidate_scores(spark):
    x, m = X.Inputs(spark, SF), pool(spark, SF)
    got = QUERIES["candidate_scores"](spark, SF).toPandas().set_index("universe")
    assert set(got.index) == {s["universe"] for s in SPECS}
    for s in SPECS:
        ids = Q.candidate_membership(m, [s]).where("in_panel").select("market_id")
        cells = P.overlap_panel(J.semi(x.panel, ids, "market_id"), J.semi(x.hourly, ids, "market_id")).toPandas()
        r = got.loc[s["universe"]]
        assert r.pc_90 == components_for(cells.pivot(index="ts", columns="market_id", values="p"), 0.90)
        assert r.compressibility_score == pytest.approx(1 - r.pc_90 / r.panel_market_count, abs=1e-6)
        want = 0.30 * r.balance_score + 0.20 * r.liquidity_score + 0.20 * r.coverage_score + 0.20 * r.compressibility_score + 0.10 * r.relationship_score
        assert r.overall_score == pytest.approx(want, abs=3e-6)


def test_universe_choice(spark):
    wide = X.Inputs(spark, SF).panel.toPandas().pivot(index="ts", columns="market_id", values="p")
    y = X.markets(spark, SF).toPandas().set_index("market_id").y
    seen = wide.notna().to_numpy().astype(float)
    both, hours = seen.T @ seen, seen.sum(axis=0)
    overlap = both / (hours[:, None] + hours[None, :] - both)
    every = X.Inputs(spark, SF).hourly.select("market_id").distinct().count()
    average = (overlap.sum(axis=1) - 1) / (every - 1)
    got = QUERIES["universe_choice"](spark, SF).toPandas().set_index("universe")
    scores = {}
    for name, least in THRESHOLDS.items():
        kept = wide.columns[average >= least]
        n = every if not least else len(kept)  # markets without any hour overlap with none and stay only where nothing is asked
        if n < 25:
            assert name not in got.index
            continue
        r = got.loc[name]
        assert r.market_count == n and r.pc_90 == components_for(wide[kept], 0.90)
        assert r.latent_score == pytest.approx(max(0.0, 1 - r.pc_90 / n), abs=1e-6)
        rate = y.reindex(kept).mean() if least else y.mean()
        assert r.balance_score == pytest.approx(max(0.0, 1 - abs(rate - 0.5) * 2), abs=1e-6)
        scores[name] = (r.score, -n, name)  # ties go to the smaller universe, then to the stricter one
        assert r.score == pytest.approx(0.30 * r.missingness_score + 0.25 * r.market_score + 0.25 * r.balance_score + 0.20 * r.latent_score, abs=3e-6)
    best = max(scores, key=scores.get) if len(scores) > 1 else "Universe B"
    assert set(got.recommendation) == {LETTERS[best]}
