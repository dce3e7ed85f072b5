"""Graphs and diagrams against brute force."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators.fits import covariances
from tidepanel.operators import graph as G
from tidepanel.operators import learn as L
from tidepanel.operators import topology as T
from tidepanel.plans.graphs import all_hoods

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    base = rng.random((60, 2))
    data = [(DAY + dt.timedelta(hours=t), m, float(0.3 + 0.2 * base[t, m % 2] + 0.05 * rng.random()))
            for t in range(60) for m in range(20) if rng.random() < 0.8]
    data += [(DAY + dt.timedelta(hours=t), 99, 0.4) for t in range(60)]
    return spark.createDataFrame(data, "ts timestamp_ntz, market_id bigint, p double")


@pytest.mark.parametrize("blocks,chunk", [(1, 1024), (3, 24), (4, None)])
def test_blocked_correlation_equals_pandas(cells, blocks, chunk):
    wide = cells.toPandas().pivot(index="ts", columns="market_id", values="p")
    want = wide.corr(min_periods=24)
    got = G.correlations(cells, min_hours=24, blocks=blocks, chunk_hours=chunk).toPandas()
    assert len(got) == 21 * 20 / 2
    for r in got.itertuples():
        w = want.loc[r.a, r.b]
        assert (pd.isna(r.r) and (r.a == 99 or r.b == 99)) or abs(r.r - w) < 1e-9


def test_components_and_triangles_with_a_hub(spark):
    chain = [("g", i, i + 1) for i in range(40)]
    hub = [("g", 100, i) for i in range(101, 140)] + [("g", 101, 102), ("h", 1, 2), ("h", 2, 3), ("h", 1, 3)]
    edges = spark.createDataFrame(chain + hub, "k string, a int, b int")
    sizes = spark.createDataFrame([("g", 90), ("h", 5), ("empty", 4)], "k string, n int")
    got = {r["k"]: r for r in G.graph_features(edges, sizes, ["k"]).collect()}
    assert got["g"]["components"] == (90 - 41 - 40) + 2 and got["g"]["cycle_rank"] == 1
    assert got["h"]["components"] == 3 and got["h"]["clustering"] == 1.0
    assert got["empty"]["components"] == 4 and got["empty"]["edges"] == 0


def test_nearest_points_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.random((50, 3))
    points = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(50)], "market_id int, x array<double>")
    got = G.nearest_points(points, 4, 5).toPandas()
    for i in range(50):
        gap = np.linalg.norm(x - x[i], axis=1)
        gap[i] = np.inf
        assert got[got.owner == i].sort_values("rank").member.tolist() == np.argsort(gap, kind="stable")[:4].tolist()


def test_random_neighbors_are_distinct_others(spark):
    ids = spark.createDataFrame([(i,) for i in range(23)], "market_id bigint")
    got = G.random_neighbors(ids, 5, 7).toPandas()
    assert (got.owner != got.member).all() and got.groupby("owner").member.nunique().eq(5).all() and got.owner.nunique() == 23


@pytest.mark.parametrize("m,k", [(11, 10), (6, 10), (2, 3)])
def test_random_neighbors_are_never_short(spark, m, k):
    ids = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(m)], "g string, market_id bigint")
    got = G.random_neighbors(ids, k, 7, ["g"]).toPandas()
    assert (got.owner != got.member).all() and len(got) == 2 * m * min(k, m - 1)
    assert got.groupby(["g", "owner"]).member.nunique().eq(min(k, m - 1)).all()


def test_neighbourhoods_of_every_method_and_size(spark, cells):
    live = G.varying(cells.selectExpr("1 AS fold", "*"), ["fold"])
    hoods = all_hoods(live, G.correlations(live, ["fold"], min_hours=2)).toPandas()
    assert set(hoods.method) == {"top_corr", "random", "nearest_pca"} and (hoods.owner != hoods.member).all()
    for (_, k, _), members in hoods.groupby(["method", "k", "owner"]).member:
        assert members.nunique() == len(members) == min(k, 19)
    assert hoods.groupby("method").owner.nunique().eq(20).all()


def reduce_matrix(dist):
    """Loops by reducing the whole boundary matrix."""
    n = len(dist)
    simplices = [((v,), 0.0) for v in range(n)]
    for k in (2, 3):
        simplices += [(s, max(dist[a, b] for a, b in itertools.combinations(s, 2))) for s in itertools.combinations(range(n), k)]
    simplices.sort(key=lambda s: (s[1], len(s[0]), s[0]))
    at = {s: i for i, (s, _) in enumerate(simplices)}
    low, out = {}, []
    for i, (s, size) in enumerate(simplices):
        col = {at[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while col and max(col) in low:
            col = col ^ low[max(col)]
        if col:
            low[max(col)] = col
            face, born = simplices[max(col)]
            if len(face) == 2 and size > born:
                out.append((born, size))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_loops_equal_full_reduction(seed):
    x = np.random.default_rng(seed).random((13, 2))
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(sorted(map(tuple, T.loop_pairs(dist))), reduce_matrix(dist))


def test_circle_has_one_long_loop_and_line_none():
    angle = np.linspace(0, 2 * np.pi, 13)[:-1]
    x = np.c_[np.cos(angle), np.sin(angle)]
    loops = T.loop_pairs(np.linalg.norm(x[:, None] - x[None], axis=2))
    assert (loops[:, 1] - loops[:, 0] > 0.5).sum() == 1
    line = np.arange(12.0)
    dist = np.abs(line[:, None] - line[None])
    assert len(T.loop_pairs(dist)) == 0 and np.allclose(T.component_deaths(dist), 1.0)


def test_constant_window_has_no_persistence():
    dist = np.zeros((8, 8))
    assert len(T.loop_pairs(dist)) == 0 and np.allclose(T.component_deaths(dist), 0.0)


def test_a_week_of_hours_is_exact_and_quick():
    x = np.cumsum(np.random.default_rng(0).normal(size=(168, 20)), axis=0)
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    loops = T.loop_pairs(dist)
    assert len(loops) and (loops[:, 1] > loops[:, 0]).all()


def test_components_equal_singular_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    _, mean, cov = covariances(df.selectExpr("1 AS k", "x"), "k")["1"]
    fitted = L.components_of(mean, cov)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(fitted.ratio, s**2 / (s**2).sum())
    got = np.array([r[0] for r in df.select(fitted.residuals(df["x"], 4)).collect()])
    assert np.abs(got).max() < 1e-9
    top = np.abs(fitted.loadings).argmax(axis=0)
    assert (fitted.loadings[top, range(4)] > 0).all()


def test_compressibility_of_many_universes(spark):
    rng = np.random.default_rng(9)
    x = {"few": rng.normal(size=(30, 2)) @ rng.normal(size=(2, 12)), "flat": rng.normal(size=(40, 25)), "one": rng.normal(size=(30, 1))}
    rows = [(u, DAY + dt.timedelta(hours=t), m, float(v[t, m])) for u, v in x.items() for t in range(v.shape[0]) for m in range(v.shape[1])]
    got = L.compressibility(spark.createDataFrame(rows, "universe string, ts timestamp_ntz, market_id int, p double"))
    assert got["one"] == dict.fromkeys(L.COMPRESSED)
    for u in ("few", "flat"):
        s = np.linalg.svd((x[u] - x[u].mean(axis=0)) / x[u].std(axis=0), compute_uv=False) ** 2
        total = np.cumsum(s) / s.sum()
        assert [got[u][k] for k in ("pc_85", "pc_90", "pc_95")] == [int(np.searchsorted(total, v) + 1) for v in (0.85, 0.90, 0.95)]
        assert np.allclose([got[u]["pc1_variance"], got[u]["pc2_cumulative_variance"], got[u]["pc5_cumulative_variance"]], total[[0, 1, 4]])




def test_dynamic_neighbourhoods_of_all_lengths_together(spark, cells):
    """Windows of two lengths in one job, with gaps, a flat market and a member without prices, against brute force."""
    near = spark.createDataFrame([(1, o, m) for o in range(5) for m in (o + 5, o + 6, 99, 200)], "fold int, owner bigint, member bigint")
    index = cells.select("ts").distinct()
    got = {(r.window_hours, r.window_end, r.owner, r.t): r for r in G.dynamic_neighborhood_graphs(cells, index, near, (12, 24), 12, keys=["fold"]).collect()}
    wide, seen = cells.toPandas().pivot(index="ts", columns="market_id", values="p"), 0
    for w in (12, 24):
        for end in (t for t in wide.index if t.hour % 12 == 0 and t >= wide.index[0] + pd.Timedelta(hours=w - 1)):
            part = wide[(wide.index > end - pd.Timedelta(hours=w)) & (wide.index <= end)]
            rest = (part - part.mean()).fillna(0.0)
            for o in range(5):
                ids = [o, o + 5, o + 6]  # the flat market and the missing one have no edge
                r = {(a, b): (rest[a] * rest[b]).sum() / np.sqrt((rest[a] ** 2).sum() * (rest[b] ** 2).sum()) for a, b in itertools.combinations(ids, 2)}
                for t in G.THRESHOLDS:
                    edges, row = sum(abs(v) >= t for v in r.values()), got[w, end.to_pydatetime(), o, t]
                    assert (row.nodes, row.edges, row.components) == (5, edges, 5 - min(edges, 2)) and row.clustering == (1.0 if edges == 3 else 0.0)
                    seen += 1
    assert seen == len(got)
    alone = G.dynamic_neighborhood_graphs(cells, index, near, 24, 12, keys=["fold"])
    assert alone.columns[0] == "window_end" and alone.count() == sum(k[0] == 24 for k in got)


def test_prices_of_neighbourhoods_from_runs(spark, cells):
    own = spark.createDataFrame([(o, m) for o in range(5) for m in (o, o + 5, 99)], "owner bigint, member bigint")
    got = {r.owner: r for r in G.neighborhood_prices(own, cells, ["owner"], []).collect()}
    wide = cells.toPandas().pivot(index="ts", columns="market_id", values="p")
    for o in range(5):
        part = wide[[o, o + 5, 99]]
        assert abs(got[o].prob_mean - part.mean(axis=1).mean()) < 1e-12 and abs(got[o].prob_std - part.std(axis=1, ddof=0).mean()) < 1e-12


def test_nearest_points_with_ties_copies_and_far_points(spark):
    """Copies and ties go by id, a point that is no number has no part, and large coordinates do not blur small distances."""
    rng = np.random.default_rng(9)
    x = np.r_[np.repeat(rng.random((4, 3)), 8, axis=0), rng.integers(0, 3, (30, 3)).astype(float), 1e6 + 1e-3 * rng.random((20, 3))]
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, [float("nan"), 0.0, 0.0])], "market_id int, x array<double>")
    assert G.point_blocks(points) == 1
    for blocks in (1, 3):
        got = G.nearest_points(points, 4, blocks).toPandas()
        assert set(got.owner) | set(got.member) == set(range(len(x)))
        for i in range(len(x)):
            gap = np.round(np.linalg.norm(x - x[i], axis=1), 9)
            gap[i] = np.inf
            assert got[got.owner == i].sort_values("rank").member.tolist() == np.argsort(gap, kind="stable")[:4].tolist()


def test_nearest_points_of_a_repeated_owner_are_told_once(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in (1, 1, 2, 3, 4)], "market_id int, x array<double>")
    got = {(r.owner, r.rank): r.member for r in G.nearest_points(points, 2, 1).collect()}
    assert got[1, 1] == 2 and got[1, 2] == 3 and (1, 3) not in got and got[4, 1] == 3


def test_neighbourhoods_need_no_table_of_pairs(spark, cells, monkeypatch):
    """Graphs and controls of neighbourhoods whose series meet, gaps and a member without prices included, are those of a table of all pairs."""
    live = cells.selectExpr("1 AS fold", "*")
    corr = G.correlations(live, ["fold"], min_hours=2)
    near = spark.createDataFrame([(1, o, (o * 3 + j) % 20) for o in range(20) for j in range(1, 5 + o % 3)] + [(1, 3, 99), (1, 4, 1000), (1, 2000, 1000)], "fold int, owner long, member long")
    near = near.where("owner <> member").cache()
    order = ["owner", "t"]
    graphs = G.neighborhood_graphs(near, corr, ["fold"]).toPandas().sort_values(order, ignore_index=True)
    controls = G.neighborhood_controls(near, corr, live, ["fold"]).toPandas().sort_values("owner", ignore_index=True)
    monkeypatch.setattr(G.S, "pairs", None)
    met = G.Strengths(live, ["fold"])
    pd.testing.assert_frame_equal(G.neighborhood_graphs(near, met, ["fold"]).toPandas().sort_values(order, ignore_index=True), graphs, check_dtype=False)
    pd.testing.assert_frame_equal(G.neighborhood_controls(near, met, keys=["fold"]).toPandas().sort_values("owner", ignore_index=True), controls, check_dtype=False, atol=1e-9)
    hoods = all_hoods(live, met, ["top_corr"])
    assert hoods.where("k = 10").groupBy("owner").count().where("count <> 10").isEmpty()


def test_many_small_graphs_by_bits():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 11):
        adj = np.triu(rng.random((600, n, n)) < 0.3, 1)
        adj = adj | adj.transpose(0, 2, 1)
        want = [np.concatenate(c) for c in zip(*(G._small_graphs(adj[i:i + 100]) for i in range(0, 600, 100)))]
        assert all(np.array_equal(a, b) for a, b in zip(G._bit_graphs(adj), want))


def test_dynamic_neighbourhoods_without_gaps(spark):
    """Windows made of slices that are multiplied once tell what every window tells by itself; values far from zero with small moves included."""
    rng = np.random.default_rng(6)
    x = 0.9 + 1e-4 * np.cumsum(rng.normal(size=(200, 12)), axis=0)
    x[:, 3], x[40:120, 5] = 0.4, 0.7
    rows = [(DAY + dt.timedelta(hours=t), m, float(x[t, m])) for t in range(200) for m in range(12)]
    cells = spark.createDataFrame(rows, "ts timestamp_ntz, market_id bigint, p double")
    near = spark.createDataFrame([(o, (o + j) % 12) for o in range(12) for j in (1, 2, 3, 4)], "owner bigint, member bigint")
    got = {(r.window_hours, r.window_end, r.owner, r.t): r for r in G.dynamic_neighborhood_graphs(cells, cells.select("ts").distinct(), near, (24, 72), 12).collect()}
    assert len(got) == (15 + 11) * 12 * 3
    for (w, end, o, t), row in got.items():
        at = int((end - DAY).total_seconds() // 3600)
        part = x[at - w + 1:at + 1][:, [(o + j) % 12 for j in range(5)]]
        moves = part.max(axis=0) > part.min(axis=0)
        with np.errstate(all="ignore"):
            r = np.nan_to_num(np.corrcoef(part.T)) * np.outer(moves, moves)
        edges = int((np.round(np.abs(r[np.triu_indices(5, 1)]), 9) >= t).sum())
        assert (row.nodes, row.edges) == (5, edges)


def test_graphs_described_whole_equal_those_of_the_forest(spark, monkeypatch):
    """Dense graphs, one without edges, one without pairs, missing strengths and isolated nodes; the wedges are not joined."""
    rng = np.random.default_rng(7)
    rows = [(g, a, b, float(rng.uniform(-1, 1)) if rng.random() < 0.9 else None) for g, n in ((1, 30), (2, 6)) for a in range(n) for b in range(a + 1, n) if g == 1 or rng.random() < 0.4]
    corr = spark.createDataFrame([*rows, (3, 1, 2, 0.1)], "g int, a long, b long, r double")
    sizes = spark.createDataFrame([(1, 33), (2, 8), (3, 2), (4, 5)], "g int, n long")
    with monkeypatch.context() as held:
        held.setattr(G, "DENSE_NODES", 0)
        want = G.threshold_graphs(corr, sizes, ["g"]).toPandas()
    monkeypatch.setattr(G, "triangle_counts", None)
    got = G.threshold_graphs(corr, sizes, ["g"]).toPandas()
    order = ["g", "t"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)
    assert len(got) == 12
