"""Edges of panel building, merging and as-of joins, against hand-made or pandas results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.operators import folds as FO
from tidepanel.operators import joins as J
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.sources import files as I

DAY = dt.datetime(2024, 1, 1)
TICKS = "ts timestamp_ntz, market_id bigint, p double, source string, event_id bigint"


def at(hours, minutes=0):
    return DAY + dt.timedelta(hours=hours, minutes=minutes)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bucket_last_breaks_ties_by_source(spark):
    t = spark.createDataFrame([
        (at(0, 5), 1, 0.1, "trade", 1), (at(0, 5), 1, 0.2, "sampled", 2), (at(0, 1), 1, 0.9, "trade", 3), (at(1), 1, None, "trade", 4),
    ], TICKS)
    assert rows(P.bucket_last(t), "ts", "market_id", "p") == [(at(0), 1, 0.1)]


@pytest.fixture(scope="module")
def hourly(spark):
    return spark.createDataFrame([(at(0), 1, 0.1), (at(5), 1, 0.5), (at(2), 2, 0.0), (at(6), 2, 1.0)], "ts timestamp_ntz, market_id bigint, p double")


def test_forward_fill_limit_counts_hours(hourly):
    got = rows(P.forward_fill(hourly, limit=2).where("market_id = 1"), "ts", "p")
    assert got == [(at(0), 0.1), (at(1), 0.1), (at(2), 0.1), (at(5), 0.5), (at(6), 0.5)]


def test_active_windows_and_missing_bounds(spark, hourly):
    markets = spark.createDataFrame(
        [(1, at(1, 30), None, at(4, 15)), (2, at(0), None, None)], "market_id bigint, start_ts timestamp_ntz, close_ts timestamp_ntz, end_ts timestamp_ntz")
    w = P.active_windows(hourly, markets, end="end_ts")
    assert rows(w, "market_id", "active_start", "active_end") == [(1, at(1), at(5))]
    assert rows(P.active_ffill(hourly, w), "ts", "p") == [(at(1), 0.1), (at(2), 0.1), (at(3), 0.1), (at(4), 0.1), (at(5), 0.5)]


@pytest.mark.parametrize("bfill", [True, False])
def test_dense_fill_matches_pandas(hourly, bfill):
    wide = hourly.toPandas().pivot(index="ts", columns="market_id", values="p").reindex(pd.date_range(at(0), at(6), freq="1h")).ffill()
    wide = (wide.bfill() if bfill else wide).fillna(0.5)
    got = P.dense_fill(hourly, bfill=bfill).toPandas().pivot(index="ts", columns="market_id", values="p")
    assert np.allclose(got.to_numpy(), wide.to_numpy())


def brute_strict(wide, min_active, min_markets, max_missing):
    sub = wide[wide.notna().sum(axis=1) >= min_active]
    n = sub.notna().sum()
    order = sorted(n.index, key=lambda c: (-n[c], c))
    best = None
    for m in range(min_markets, len(order) + 1):
        c = sub[order[:m]]
        c = c[c.notna().sum(axis=1) >= min_active]
        if len(c) and c.isna().to_numpy().mean() <= max_missing:
            best = c
    return best if best is not None else sub[order[:min_markets]]


@pytest.mark.parametrize("missing", [0.2, 0.45, 0.0])
def test_strict_panel_is_the_widest_passing_prefix(spark, missing):
    rng = np.random.default_rng(3)
    keep = rng.random((30, 12)) < np.linspace(0.95, 0.2, 12)
    long = [(at(int(h)), int(m), float(rng.random())) for h, m in zip(*np.nonzero(keep))]
    cells = spark.createDataFrame(long, "ts timestamp_ntz, market_id bigint, p double")
    got = P.strict_panel(cells, cells, 4, 3, missing).toPandas()
    wide = cells.toPandas().pivot(index="ts", columns="market_id", values="p")
    want = brute_strict(wide, 4, 3, missing).stack()
    assert sorted(zip(got.ts, got.market_id)) == sorted(want.index.tolist())


def test_keep_last_treats_nulls_as_equal(spark):
    t = spark.createDataFrame([(1, None, 1), (1, None, 2), (2, "x", 1)], "k int, h string, copy int")
    assert rows(M.keep_last(t, ["k", "h"], ["copy"]), "k", "copy") == [(1, 2), (2, 1)]
    assert M.duplicate_count(t, ["k", "h", "absent"]).first()[0] == 1


def test_absent_source_is_empty_and_ordered(spark):
    out = M.align_source(None, "x", spark)
    assert out.columns == list(M.PRICE_COLUMNS) and out.isEmpty()


@pytest.mark.parametrize("by", [None, ["k"]])
def test_asof_matches_pandas_across_slices(spark, by):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"ts": [at(int(h)) for h in rng.integers(0, 500, 80)], "k": rng.integers(0, 3, 80), "i": range(80)}).sort_values("ts")
    right = pd.DataFrame({"ts": [at(int(h)) for h in rng.choice(500, 15, replace=False)], "k": rng.integers(0, 3, 15), "v": rng.random(15)}).sort_values("ts")
    want = pd.merge_asof(left, right if by else right.drop(columns="k"), on="ts", by=by)
    got = J.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], by=by).toPandas()
    merged = want.merge(got, on="i", suffixes=("_w", "_g"))
    assert len(merged) == 80 and np.allclose(merged.v_w.fillna(-1), merged.v_g.fillna(-1))


def test_quantiles_are_exact_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(500, 0.5), rng.random(301), [0.0, 1.0]])
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in ordered.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.99}).collect()}
    for k in (0, 1):
        assert np.allclose(got[k], np.quantile(v[k::2], [0.5, 0.99]))


def test_ranges_are_even_where_values_crowd(spark):
    """99 % of the distinct values lie in a thousandth of the span: no range holds twice the median's rows."""
    rng = np.random.default_rng(2)
    v = np.concatenate([0.5 + rng.random(9900) / 1000, rng.random(100)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(8)
    sizes = sorted(r["count"] for r in ordered.in_ranges(df, [], [F.col("v")]).groupBy("__range").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    assert np.allclose(ordered.quantiles(df, [], "v", {"m": 0.5, "p": 0.001}).first(), np.quantile(v, [0.5, 0.001]))


def test_dense_index_spans_months(spark):
    stamps = [at(h * 50) for h in range(60)]
    df = spark.createDataFrame([(s,) for s in stamps * 2], "ts timestamp_ntz")
    assert [r["idx"] for r in ordered.dense_index(df).orderBy("ts").collect()] == list(range(60))


def test_folds_never_overlap_and_short_test_is_dropped(spark):
    df = spark.createDataFrame([(at(h),) for h in range(100)], "ts timestamp_ntz")
    got = FO.chronological_folds(df, 0.6, 15, 15, 12).orderBy("fold").collect()
    assert [r["test_start"] for r in got] == [at(60), at(75)]
    assert all(r["train_end"] < r["test_start"] <= r["test_end"] for r in got)


def test_bounds_reversed_and_chunks(spark):
    m = spark.createDataFrame([(1, at(0), at(60)), (2, at(5), at(5)), (3, at(0), None)], "market_id bigint, start_ts timestamp_ntz, close_ts timestamp_ntz")
    b = I.active_bounds(m)
    assert [r["bound_start"] for r in b.orderBy("market_id").collect()] == [at(0), None, None]
    assert rows(I.chunk_time_range(b, 1), "chunk_start", "chunk_stop") == [(at(0), at(24)), (at(24), at(48)), (at(48), at(60))]


def test_feature_at_t_ignores_later_rows(spark, hourly):
    full = rows(P.dense_fill(hourly).where(F.col("ts") <= at(4)), "ts", "market_id", "p")
    cut = spark.createDataFrame([(at(0), 1, 0.1), (at(2), 2, 0.0), (at(6), 1, 0.7), (at(6), 2, 0.3)], "ts timestamp_ntz, market_id bigint, p double")
    assert rows(P.dense_fill(cut).where(F.col("ts") <= at(4)), "ts", "market_id", "p") == full


def test_tolerant_timestamps(spark):
    from tidepanel.functions import scalars as S

    told = {
        "2020-10-02T16:10:01.538Z": "2020-10-02 16:10:01.538", "2020-11-02 16:31:01+00": "2020-11-02 16:31:01", "2021-01-01T00:30:00+02:00": "2020-12-31 22:30:00",
        "2021-01-01": "2021-01-01 00:00:00", "03/04/2021": "2021-03-04 00:00:00", "12:30": None, "soon": None, "2021": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in told], "text string").select("text", S.tolerant_timestamp("text").cast("string").alias("ts"))
    assert {r.text: r.ts for r in df.collect()} == told


def test_direction_in_any_case(spark):
    from pyspark.sql import functions as F

    from tidepanel.functions import classify as C

    df = spark.createDataFrame([("Reach 10?",), ("reach 10?",), ("FALL below 5",), ("stay",)], "q string")
    assert [r[0] for r in df.select(C.infer_direction(F.col("q"))).collect()] == ["above", "above", "below", None]


def test_raw_market_files_of_either_layout(spark, tmp_path):
    from tidepanel.sources import files as I

    (tmp_path / "whole").mkdir(), (tmp_path / "lines").mkdir()
    (tmp_path / "whole" / "a.json").write_text('[\n  {\n    "id": "1"\n  },\n  {\n    "id": "2"\n  }\n]\n')
    (tmp_path / "lines" / "a.json").write_text('[{"id": "1"}]\n[{"id": "2"}]\n')
    assert sorted(r.id for r in I.scan_raw_markets(spark, str(tmp_path / "whole")).collect()) == ["1", "2"]
    assert sorted(r.id for r in I.scan_raw_markets(spark, str(tmp_path / "lines"), array_per_line=True).collect()) == ["1", "2"]


def test_blocks_of_the_wide_form_hold_every_market_and_hour(spark):
    """More markets than a block has places, and an hour in which only one outside 1-8 has a price."""
    told = {(at(m % 5), m): m / 200 for m in range(1, 131)} | {(at(9), 77): 0.5}
    cells = spark.createDataFrame([(*k, v) for k, v in told.items()], "ts timestamp_ntz, market_id bigint, p double")
    places = P.market_places(cells)
    spot = {(r.block, r.place): r.market_id for r in places.collect()}
    assert sorted(spot.values()) == list(range(1, 131)) and max(b for b, _ in spot) == 2
    wide = P.pivot_blocks(cells, places).collect()
    assert {(r.ts, spot[r.block, i]): v for r in wide for i, v in enumerate(r["values"]) if v is not None} == told
