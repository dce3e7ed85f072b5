"""Overlaps of lifetimes against plain loops over pairs."""

import datetime as dt
import itertools

import numpy as np
import pytest

from tidepanel.operators import graph as G

DAY = dt.datetime(2024, 1, 1)


def lives_of(spark, seed=4):
    """Markets with equal, broken, far and repeated hours; one column without any."""
    rng = np.random.default_rng(seed)
    hours = {m: set(range(int(a := rng.integers(0, 60)), int(a) + 40)) for m in range(12)} | {m: set(range(5, 45)) for m in range(12, 18)}
    hours |= {18: {1, 2, 50, 51, 90}, 19: set(range(3000, 3040)), 20: set(range(3010, 3030))}
    rows = [(DAY + dt.timedelta(hours=h), m) for m, s in hours.items() for h in sorted(s)]
    rows += [r for r in rows if r[1] == 3]  # a market whose rows come twice counts them twice in its size
    size = {m: len(s) * (2 if m == 3 else 1) for m, s in hours.items()}
    mask = spark.createDataFrame(rows, "ts timestamp_ntz, market_id long")
    columns = spark.createDataFrame([(m,) for m in [*hours, 99]], "market_id long")
    pairs = {(a, b): (n := len(hours[a] & hours[b])) / (size[a] + size[b] - n) for a, b in itertools.combinations(hours, 2)}
    pairs |= {(m, 99): 0.0 for m in hours}
    return mask, columns, pairs


@pytest.mark.parametrize("block", [1024, 4])
def test_overlaps_equal_those_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(G, "LIFETIMES", block)
    mask, columns, pairs = lives_of(spark)
    monkeypatch.setattr(G, "pair_sums", None)  # no table of pairs may be made
    lives = G.Lifetimes(mask)
    got = {r.market_id: r.average_overlap for r in G.average_overlap(lives, columns).collect()}
    for m in got:
        assert got[m] == pytest.approx(sum(o for p, o in pairs.items() if m in p) / 21)
    s, o = G.overlap_stats(lives, columns).first(), np.array(list(pairs.values()))
    assert s.pairs == len(o) and s.mean_overlap == pytest.approx(o.mean()) and s.median_overlap == pytest.approx(np.median(o))
    assert (s.min_overlap, s.max_overlap) == (o.min(), o.max())
    assert [s.share_zero, s.share_ge_10, s.share_ge_25] == pytest.approx([(o == 0).mean(), (o >= 0.10).mean(), (o >= 0.25).mean()])
    kept = [12, 13, 14, 0, 3, 18, 99]
    inside = lives.counts(spark.createDataFrame([("u", m) for m in kept], "universe string, market_id long")).collect()
    want = [v for (a, b), v in pairs.items() if a in kept and b in kept and v > 0]
    assert sorted(x for r in inside for x in [r.overlap] * r.weight) == pytest.approx(sorted(want))
    assert len(inside) <= len(want)
