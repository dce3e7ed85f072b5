"""Queries that return every row, on tables made here."""

import datetime as dt

import pytest

from tidepanel.plans.catalog import QUERIES

DAY = dt.datetime(2024, 1, 1)
HOURS, MARKETS = 24 * 14, 6


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Six markets of two families with a price each third hour."""
    d = str(tmp_path_factory.mktemp("rows"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, 0)], "n_nationkey int, n_regionkey int")
    put("customer", [(m, 0, "FURNITURE" if m % 2 else "BUILDING", 9000.0 if m % 3 else 10.0) for m in range(MARKETS)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    events = [(h * MARKETS + m, DAY + dt.timedelta(hours=h, minutes=5), m, "view", 1.0 + (h * 7 + m * 31) % 97) for h in range(0, HOURS, 3) for m in range(MARKETS)]
    put("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    return d


def panel(spark, d):
    from tidepanel import fixtures as X

    return {(r.ts, r.market_id): r.p for r in X.active_panel(spark, d).collect()}


def test_future_targets_has_every_row(spark, tables):
    cells = panel(spark, tables)
    got = {(r.ts, r.market_id): r for r in QUERIES["future_targets"](spark, tables).collect()}
    assert got.keys() == cells.keys()
    for (ts, m), r in got.items():
        later = cells.get((ts + dt.timedelta(hours=24), m))
        assert r.future_price_24h == (None if later is None else round(later, 6))
        assert r.large_move_24h == (None if later is None else int(abs(later - cells[ts, m]) >= 0.10))


def test_shift_join_has_every_row(spark, tables):
    cells = panel(spark, tables)
    got = {(r.ts, r.market_id): (r.p, r.later) for r in QUERIES["shift_join"](spark, tables).collect()}
    later = {k: cells.get((k[0] + dt.timedelta(hours=24), k[1])) for k in cells}
    assert got == {k: (round(p, 6), None if later[k] is None else round(later[k], 6)) for k, p in cells.items()}


def test_fit_impute_scale_has_every_hour(spark, tables):
    got = QUERIES["fit_impute_scale"](spark, tables)
    assert set(got.columns) == {"fold", "ts", "feature", "z"}
    rows = got.collect()
    assert len({(r.fold, r.ts, r.feature) for r in rows}) == len(rows)
    hours = {}
    for r in rows:
        hours.setdefault((r.fold, r.feature), set()).add(r.ts)
    assert hours and all(len(h) == len({x for s in hours.values() for x in s}) >= HOURS - 24 for h in hours.values())
