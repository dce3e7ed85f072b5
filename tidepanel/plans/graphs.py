"""Queries for correlation, threshold graphs and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import folds as FO
from tidepanel.operators import forest as T
from tidepanel.operators import graph as G
from tidepanel.operators import joins as J
from tidepanel.operators import learn as L
from tidepanel.operators import merge as M
from tidepanel.operators import pairs as R
from tidepanel.operators import panel as P
from tidepanel.plans.registry import query, r6
from tidepanel.plans.scoring import FOLD, r_all
from tidepanel.session import cut_lineage

MIN_HOURS, K, STRIDE = 6, 10, 24
WINDOWS = (24, 72, 168)

X.add_cte("pcorr", f"""
    SELECT a.market_id AS a, b.market_id AS b, count(*) AS n, CASE WHEN min(a.p) < max(a.p) AND min(b.p) < max(b.p) THEN corr(a.p, b.p) END AS r
    FROM panel a JOIN panel b ON a.ts = b.ts AND a.market_id < b.market_id GROUP BY 1, 2 HAVING count(*) >= {MIN_HOURS}""", ["panel"])
X.add_cte("train", "SELECT f.fold, d.* FROM dense d JOIN folds f ON d.ts BETWEEN f.train_start AND f.train_end", ["dense", "folds"])
X.add_cte("live", """
    SELECT t.* FROM train t JOIN (SELECT fold, market_id FROM train GROUP BY 1, 2 HAVING min(p) < max(p)) USING (fold, market_id)""", ["train"])
X.add_cte("tcorr", """
    SELECT a.fold, a.market_id AS a, b.market_id AS b, count(*) AS n, corr(a.p, b.p) AS r FROM live a JOIN live b ON a.fold = b.fold AND a.ts = b.ts
      AND a.market_id < b.market_id GROUP BY 1, 2, 3""", ["live"])
X.add_cte("cuts", "SELECT CAST(unnest([0.3, 0.5, 0.7]) AS DOUBLE) AS t", [])


def graph_sql(nodes, edges, keys):
    """Graph features in SQL for node and edge views with the given key columns (a, b once per edge)."""
    k = ", ".join(keys)
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    return f"""
    WITH RECURSIVE nd AS ({nodes}), ed AS ({edges}),
    both_ways AS (SELECT {k}, a AS u, b AS v FROM ed UNION ALL SELECT {k}, b, a FROM ed),
    reach AS (SELECT {k}, node AS src, node AS dst FROM nd UNION SELECT {', '.join('r.' + c for c in keys)}, r.src, w.v FROM reach r JOIN both_ways w
      ON {on('r', 'w')} AND r.dst = w.u),
    comp AS (SELECT {k}, count(*) AS components FROM (SELECT {k}, src FROM reach GROUP BY {k}, src HAVING min(dst) = src) GROUP BY {k}),
    deg AS (SELECT {k}, u, count(*) AS d FROM both_ways GROUP BY {k}, u),
    trip AS (SELECT {k}, sum(d * (d - 1) / 2) AS triples FROM deg GROUP BY {k}),
    tri AS (SELECT {', '.join('x.' + c for c in keys)}, count(*) AS triangles FROM ed x JOIN ed y ON {on('x', 'y')} AND x.b = y.a
      JOIN ed z ON {on('x', 'z')} AND z.a = x.a AND z.b = y.b GROUP BY {', '.join('x.' + c for c in keys)}),
    sz AS (SELECT {k}, count(*) AS n FROM nd GROUP BY {k}), ne AS (SELECT {k}, count(*) AS e FROM ed GROUP BY {k})
    SELECT {k}, n AS nodes, coalesce(e, 0) AS edges, components, CAST(greatest(coalesce(e, 0) - n + components, 0) AS BIGINT) AS cycle_rank,
      round(coalesce(e, 0) / greatest(n * (n - 1) / 2, 1), 6) AS edge_density, round(2.0 * coalesce(e, 0) / n, 6) AS avg_degree,
      round(CASE WHEN triples > 0 THEN 3.0 * coalesce(triangles, 0) / triples ELSE 0 END, 6) AS clustering
    FROM sz LEFT JOIN ne USING ({k}) JOIN comp USING ({k}) LEFT JOIN trip USING ({k}) LEFT JOIN tri USING ({k})"""


def with_graph(views, nodes, edges, keys):
    """The views and a recursive query over them; recursion must be declared for the whole statement."""
    body = graph_sql(nodes, edges, keys).strip()
    text = X.with_views(views, "WITH " + body[len("WITH RECURSIVE "):])
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("pairwise_correlation", X.with_views("pcorr", "SELECT a, b, n, round(r, 6) AS r FROM pcorr"))
def pairwise_correlation(spark, d):
    return G.correlations(X.active_panel(spark, d), min_hours=MIN_HOURS).select("a", "b", "n", r6("r"))


@query("correlation_summary", X.with_views("pcorr", """
    SELECT round(avg(abs(r)), 6) AS mean_abs_corr, count(r) AS pairs, round(median(abs(r)), 6) AS median_abs_corr FROM pcorr WHERE r IS NOT NULL"""))
def correlation_summary(spark, d):
    return r_all(G.correlation_summary(X.active_panel(spark, d), MIN_HOURS))


def train_cells(spark, d, split="train"):
    """Dense prices of every fold's hours, markets that vary there only."""
    h = X.hourly(spark, d)
    cells = P.active_ffill(h, P.active_windows(h, X.markets(spark, d)))
    hours = J.fold_hours(FO.chronological_folds(cells, **FOLD)).where(F.col("split") == split)
    return cut_lineage(G.varying(P.dense_fill(h).join(hours.select("fold", "ts"), "ts"), ["fold"]))


def train_corr(live):
    """The correlations of every fold, told where neighbourhoods ask for them: all pairs are neither written nor joined."""
    return G.Strengths(live, ["fold"])


def nearest_by(corr, k):
    """The k markets most correlated with each market of a fold, by a table of pairs or where series meet."""
    return R.top_correlated(corr, ["fold"], k) if isinstance(corr, G.Strengths) else G.top_corr_neighbors(corr, k, ["fold"])


def neighbours(corr, k=K):
    return cut_lineage(nearest_by(corr, k))


@query("threshold_graph_features", with_graph(
    "tcorr cuts", "SELECT fold, t, market_id AS node FROM (SELECT DISTINCT fold, market_id FROM live), cuts",
    "SELECT fold, t, a, b FROM tcorr, cuts WHERE round(abs(r), 9) >= t", ["fold", "t"]))
def threshold_graph_features(spark, d):
    live = train_cells(spark, d)
    sizes = live.groupBy("fold").agg(F.countDistinct("market_id").alias("n"))
    return r_all(G.threshold_graphs(cut_lineage(R.strong_pairs(live, ["fold"], min(G.THRESHOLDS))), sizes, ["fold"]), "t")


CURVE = (0.01, 0.02, *(round(0.05 * i, 2) for i in range(1, 20)), 0.97, 0.99)


@query("threshold_component_curve", X.with_views("tcorr", f"""
    WITH cuts23 AS (SELECT CAST(unnest([{', '.join(map(str, CURVE))}]) AS DOUBLE) AS t),
    nd AS (SELECT fold, t, market_id AS node FROM (SELECT DISTINCT fold, market_id FROM live), cuts23),
    ed AS (SELECT fold, t, a, b FROM tcorr, cuts23 WHERE round(abs(r), 9) >= t),
    both_ways AS (SELECT fold, t, a AS u, b AS v FROM ed UNION ALL SELECT fold, t, b, a FROM ed),
    heard AS (SELECT fold, t, node, node AS label FROM nd UNION SELECT w.fold, w.t, w.v, min(h.label) FROM heard h JOIN both_ways w
      ON w.fold = h.fold AND w.t = h.t AND w.u = h.node GROUP BY w.fold, w.t, w.v HAVING min(h.label) < w.v),
    least AS (SELECT fold, t, node, min(label) AS label FROM heard GROUP BY 1, 2, 3),
    comp AS (SELECT fold, t, label, count(*) AS size FROM least GROUP BY 1, 2, 3)
    SELECT fold, t, sum(size)::BIGINT AS nodes, count(*) AS components FROM comp GROUP BY 1, 2""").replace("WITH ", "WITH RECURSIVE ", 1))
def threshold_component_curve(spark, d):
    """Components of every fold's correlation graph at twenty-three thresholds, all from one spanning forest."""
    live = train_cells(spark, d)
    forest = T.spanning_forest(R.forest_pairs(live, ["fold"]), ["fold"])
    sizes = live.groupBy("fold").agg(F.countDistinct("market_id").alias("nodes")).withColumn("t", F.explode(F.array([F.lit(t) for t in CURVE])))
    told = sizes.join(T.joins_at(forest, ["fold"], CURVE), ["fold", "t"], "left")
    return told.select("fold", "t", "nodes", (F.col("nodes") - F.coalesce("joins", F.lit(0))).alias("components"))


X.add_cte("near", f"""
    SELECT fold, owner, member, rank FROM (SELECT fold, owner, member, row_number() OVER (PARTITION BY fold, owner
      ORDER BY round(coalesce(abs(r), 0), 9) DESC, member) AS rank
      FROM (SELECT fold, a AS owner, b AS member, r FROM tcorr UNION ALL SELECT fold, b, a, r FROM tcorr)) WHERE rank <= {K}""", ["tcorr"])
X.add_cte("hood", "SELECT fold, owner, member FROM near UNION SELECT fold, owner, owner FROM near", ["near"])


@query("top_corr_neighbors", X.with_views("near", "SELECT fold, owner, member, CAST(rank AS INTEGER) AS rank FROM near"))
def top_corr_neighbors(spark, d):
    return R.top_correlated(train_cells(spark, d), ["fold"], K).select("fold", "owner", "member", "rank")


@query("top_corr_neighbor_sizes", X.with_views("tcorr", """
    SELECT fold, k, count(*) AS links, round(avg(w), 6) AS mean_abs_corr FROM (SELECT fold, owner, abs(r) AS w, row_number() OVER (PARTITION BY fold, owner
      ORDER BY round(coalesce(abs(r), 0), 9) DESC, member) AS rank
      FROM (SELECT fold, a AS owner, b AS member, r FROM tcorr UNION ALL SELECT fold, b, a, r FROM tcorr)),
      (SELECT unnest([10, 20, 40]) AS k) WHERE rank <= k GROUP BY 1, 2"""))
def top_corr_neighbor_sizes(spark, d):
    top = R.top_correlated(train_cells(spark, d), ["fold"], max(G.NEIGHBOURHOOD_SIZES))
    sized = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in G.NEIGHBOURHOOD_SIZES]))).where("rank <= k")
    return sized.groupBy("fold", "k").agg(F.count("*").alias("links"), r6(F.avg("w"), "mean_abs_corr"))


X.add_cte("rlisted", """
    SELECT fold, market_id, row_number() OVER (PARTITION BY fold ORDER BY md5('7:' || market_id), market_id) - 1 AS place,
      count(*) OVER (PARTITION BY fold) AS m FROM (SELECT DISTINCT fold, market_id FROM live)""", ["live"])


def drawn_sql(k):
    """Draws 1 ... 3k + 8 of each owner are places on the list of markets; behind them come the k + 1 places from draw 0 on."""
    return f"""
    SELECT d.fold, d.owner, l.market_id AS member, min(d.j) AS j FROM (SELECT fold, market_id AS owner, j,
        (('0x' || substr(md5('7:' || market_id || ':' || CASE WHEN j > {3 * k + 8} THEN 0 ELSE j END), 1, 12))::BIGINT + greatest(j - {3 * k + 9}, 0)) % m AS place
        FROM rlisted, (SELECT unnest(range(1, {4 * k + 10})) AS j)) d JOIN rlisted l USING (fold, place) WHERE l.market_id <> d.owner GROUP BY 1, 2, 3"""


@query("random_neighbors", X.with_views("rlisted", f"""
    SELECT fold, owner, member FROM (SELECT *, row_number() OVER (PARTITION BY fold, owner ORDER BY j) AS rank FROM ({drawn_sql(K)})) WHERE rank <= {K}"""))
def random_neighbors(spark, d):
    return G.random_neighbors(train_cells(spark, d), K, 7, ["fold"]).select("fold", "owner", "member")


@query("nearest_given_coordinates", f"""
    SELECT owner, member, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS owner, b.vec_id AS member, row_number() OVER (PARTITION BY a.vec_id
      ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= {K}""")
def nearest_given_coordinates(spark, d):
    points = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("market_id"), F.col("embedding").cast("array<double>").alias("x"))
    return G.nearest_points(points, K, G.point_blocks(points)).select("owner", "member", "rank")


# Neighbourhoods of each size by correlation.
X.add_cte("hoods", f"""
    SELECT fold, 'top_corr' AS method, k, owner, member FROM (SELECT fold, owner, member, row_number() OVER (PARTITION BY fold, owner
        ORDER BY round(coalesce(abs(r), 0), 9) DESC, member) AS rank
        FROM (SELECT fold, a AS owner, b AS member, r FROM tcorr UNION ALL SELECT fold, b, a, r FROM tcorr)),
      (SELECT unnest([{", ".join(map(str, G.NEIGHBOURHOOD_SIZES))}]) AS k) WHERE rank <= k""", ["tcorr"])
X.add_cte("hood_all", "SELECT fold, method, k, owner, member FROM hoods UNION SELECT fold, method, k, owner, owner FROM hoods", ["hoods"])
HOOD = ["fold", "method", "k"]
KMAX = max(G.NEIGHBOURHOOD_SIZES)

# Random neighbourhoods of each size, the first k of the largest one's.
X.add_cte("rmet", drawn_sql(KMAX), ["rlisted"])
X.add_cte("rhoods", f"""
    SELECT fold, 'random' AS method, k, owner, member FROM (SELECT *, row_number() OVER (PARTITION BY fold, owner ORDER BY j) AS rank FROM rmet),
      (SELECT unnest([{", ".join(map(str, G.NEIGHBOURHOOD_SIZES))}]) AS k) WHERE rank <= k""", ["rmet"])
X.add_cte("rhood_all", "SELECT fold, method, k, owner, member FROM rhoods UNION SELECT fold, method, k, owner, owner FROM rhoods", ["rhoods"])


def pca_neighbours(live, k):
    """The k nearest markets of each fold's embedding, all folds embedded together; a fold with one market has none."""
    points, parts = cut_lineage(L.market_embedding(live, "fold")), []
    for r in points.groupBy("fold").agg(F.count("*").alias("n")).where("n > 1").orderBy("fold").collect():
        own = points.where(F.col("fold") == r["fold"])
        parts.append(G.nearest_points(own, k, G.point_blocks(own)).select(F.lit(r["fold"]).alias("fold"), "owner", "member", "rank", "dist"))
    return M.union_models(parts)


def all_hoods(live, corr, methods=("top_corr", "random", "nearest_pca")):
    """Neighbourhoods of every size by each method: correlation, random draws (the placebo), distance in the fold's components."""
    make = {
        "top_corr": lambda: nearest_by(corr, KMAX),
        "random": lambda: G.random_neighbors(live, KMAX, 7, ["fold"]),
        "nearest_pca": lambda: pca_neighbours(live, KMAX),
    }
    every = M.union_models([make[m]().select("fold", F.lit(m).alias("method"), "owner", "member", "rank") for m in methods])
    sized = every.withColumn("k", F.explode(F.array(*[F.lit(k) for k in G.NEIGHBOURHOOD_SIZES]))).where("rank <= k")
    return cut_lineage(sized.select("fold", "method", "k", "owner", "member"))


def hood_topology_sql(hoods):
    return with_graph(
        f"{hoods} tcorr cuts", f"SELECT fold, method, k, owner, t, member AS node FROM {hoods}, cuts",
        f"SELECT x.fold, x.method, x.k, x.owner, t, c.a, c.b FROM {hoods} x JOIN {hoods} y ON x.fold = y.fold AND x.method = y.method AND x.k = y.k AND x.owner = y.owner "
        "AND x.member < y.member JOIN tcorr c ON c.fold = x.fold AND c.a = x.member AND c.b = y.member, cuts WHERE round(abs(c.r), 9) >= t",
        [*HOOD, "owner", "t"])


def hood_topology(spark, d, method):
    live = train_cells(spark, d)
    corr = train_corr(live)
    return r_all(G.neighborhood_graphs(all_hoods(live, corr, [method]), corr, HOOD), "t")


@query("neighborhood_topology", hood_topology_sql("hood_all"))
def neighborhood_topology(spark, d):
    return hood_topology(spark, d, "top_corr")


@query("neighborhood_topology_random", hood_topology_sql("rhood_all"))
def neighborhood_topology_random(spark, d):
    return hood_topology(spark, d, "random")


@query("neighborhood_topology_pca")
def neighborhood_topology_pca(spark, d):
    return hood_topology(spark, d, "nearest_pca")


def hood_controls_sql(hoods):
    return X.with_views(f"{hoods} tcorr live", f"""
    WITH e AS (SELECT x.fold, x.method, x.k, x.owner, avg(abs(coalesce(c.r, 0))) AS m, stddev_pop(abs(coalesce(c.r, 0))) AS s FROM {hoods} x
      JOIN {hoods} y ON x.fold = y.fold AND x.method = y.method AND x.k = y.k AND x.owner = y.owner AND x.member < y.member
      LEFT JOIN tcorr c ON c.fold = x.fold AND c.a = x.member AND c.b = y.member GROUP BY ALL),
    q AS (SELECT fold, method, k, owner, avg(m) AS m, avg(s) AS s FROM (SELECT h.fold, h.method, h.k, h.owner, l.ts, avg(l.p) AS m, stddev_pop(l.p) AS s
      FROM {hoods} h JOIN live l ON l.fold = h.fold AND l.market_id = h.member GROUP BY ALL) GROUP BY ALL)
    SELECT fold, method, k, owner, round(e.m, 6) AS corr_mean_abs, round(e.s, 6) AS corr_std_abs, round(q.m, 6) AS prob_mean, round(q.s, 6) AS prob_std
    FROM e JOIN q USING (fold, method, k, owner)""")


def hood_controls(spark, d, method):
    live = train_cells(spark, d)
    corr = train_corr(live)
    return r_all(G.neighborhood_controls(all_hoods(live, corr, [method]), corr, keys=HOOD))


@query("neighborhood_controls", hood_controls_sql("hood_all"))
def neighborhood_controls(spark, d):
    return hood_controls(spark, d, "top_corr")


@query("neighborhood_controls_random", hood_controls_sql("rhood_all"))
def neighborhood_controls_random(spark, d):
    return hood_controls(spark, d, "random")


@query("neighborhood_controls_pca")
def neighborhood_controls_pca(spark, d):
    return hood_controls(spark, d, "nearest_pca")


@query("leakage_control", X.with_views("dense folds", f"""
    WITH d AS (SELECT f.fold, d.* FROM dense d JOIN folds f ON d.ts BETWEEN f.test_start AND f.test_end),
    lv AS (SELECT d.* FROM d JOIN (SELECT fold, market_id FROM d GROUP BY 1, 2 HAVING min(p) < max(p)) USING (fold, market_id)),
    c AS (SELECT a.fold, a.market_id AS a, b.market_id AS b, corr(a.p, b.p) AS r FROM lv a JOIN lv b ON a.fold = b.fold AND a.ts = b.ts AND a.market_id < b.market_id GROUP BY 1, 2, 3),
    late AS (SELECT fold, count(*) FILTER (lv.ts > f.train_end) > 0 AS used FROM lv JOIN folds f USING (fold) GROUP BY 1)
    SELECT fold, owner, member, CAST(rank AS INTEGER) AS rank, 'test' AS source, used AS used_test_timestamps, NOT used AS is_valid FROM (
      SELECT fold, owner, member, row_number() OVER (PARTITION BY fold, owner ORDER BY round(coalesce(abs(r), 0), 9) DESC, member) AS rank
      FROM (SELECT fold, a AS owner, b AS member, r FROM c UNION ALL SELECT fold, b, a, r FROM c)) JOIN late USING (fold) WHERE rank <= {K}"""))
def leakage_control(spark, d):
    """Neighbourhoods built on the test hours; the flags follow from the hours that were used."""
    cells = train_cells(spark, d, "test")
    ends = FO.chronological_folds(X.active_panel(spark, d), **FOLD).select("fold", "train_end")
    late = cells.join(ends, "fold").groupBy("fold").agg((F.count_if(F.col("ts") > F.col("train_end")) > 0).alias("used_test_timestamps"))
    top = R.top_correlated(cells, ["fold"], K).join(late, "fold")
    return top.select("fold", "owner", "member", "rank", F.lit("test").alias("source"), "used_test_timestamps", (~F.col("used_test_timestamps")).alias("is_valid"))


X.add_cte("wins", f"""
    SELECT e.window_hours, e.ts AS window_end, d.ts, d.market_id, d.p FROM (SELECT w.window_hours, h.ts FROM hours h, span, (SELECT unnest([{", ".join(map(str, WINDOWS))}]) AS window_hours) w
      WHERE hour(h.ts) % {STRIDE} = 0 AND h.ts >= lo + to_hours(w.window_hours - 1)) e
      JOIN dense d ON d.ts > e.ts - to_hours(e.window_hours) AND d.ts <= e.ts""", ["hours", "span", "dense"])
X.add_cte("wlive", """
    SELECT w.* FROM wins w JOIN (SELECT window_hours, window_end, market_id FROM wins GROUP BY 1, 2, 3 HAVING min(p) < max(p))
      USING (window_hours, window_end, market_id)""", ["wins"])
X.add_cte("wcorr", """
    SELECT a.window_hours, a.window_end, a.market_id AS a, b.market_id AS b, corr(a.p, b.p) AS r FROM wlive a
    JOIN wlive b ON a.window_hours = b.window_hours AND a.window_end = b.window_end AND a.ts = b.ts AND a.market_id < b.market_id GROUP BY 1, 2, 3, 4""", ["wlive"])
X.add_cte("wenough", "SELECT window_hours, window_end FROM wlive GROUP BY 1, 2 HAVING count(DISTINCT market_id) >= 4", ["wlive"])
WINDOW = ["window_hours", "window_end"]


@query("rolling_corr_graph", with_graph(
    "wcorr wenough cuts", "SELECT window_hours, window_end, t, market_id AS node FROM (SELECT DISTINCT window_hours, window_end, market_id FROM wlive JOIN wenough USING (window_hours, window_end)), cuts",
    "SELECT window_hours, window_end, t, a, b FROM wcorr JOIN wenough USING (window_hours, window_end), cuts WHERE round(abs(r), 9) >= t", [*WINDOW, "t"]))
def rolling_corr_graph(spark, d):
    h = X.hourly(spark, d)
    dense, index = cut_lineage(P.dense_fill(h)), P.hour_index(h)
    return r_all(G.threshold_graphs(*sliding(dense, index, G.block_count(h)), WINDOW), "t")


def sliding(dense, index, blocks):
    """The strong pairs of every window of every length, and the varying markets of each window that has at least four."""
    first, last = index.agg(F.min(R.unix_hour()), F.max(R.unix_hour())).first()
    ends = M.union_models([P.window_ends(index, w, STRIDE).withColumn("window_hours", F.lit(w)) for w in WINDOWS])
    sizes = R.sliding_bounds(dense, WINDOWS, STRIDE, ends).groupBy(*WINDOW).agg(F.count("*").alias("n")).where("n >= 4")
    sizes = cut_lineage(sizes)
    strong = R.sliding_pairs(dense, first, last, WINDOWS, STRIDE, min(G.THRESHOLDS), blocks)
    return cut_lineage(strong.join(sizes.select(*WINDOW), WINDOW, "left_semi")), sizes


X.add_cte("dyn", f"""
    SELECT h.window_hours, h.fold, h.window_end, h.owner, c.t, count(*) FILTER (w.r IS NOT NULL AND round(abs(w.r), 9) >= c.t) AS edges, count(*) AS pairs
    FROM (SELECT e.window_hours, e.window_end, x.fold, x.owner, x.member AS a, y.member AS b FROM (SELECT DISTINCT window_hours, window_end FROM wins) e, hood x
          JOIN hood y ON x.fold = y.fold AND x.owner = y.owner AND x.member < y.member) h
    LEFT JOIN wcorr w ON w.window_hours = h.window_hours AND w.window_end = h.window_end AND w.a = h.a AND w.b = h.b CROSS JOIN cuts c GROUP BY 1, 2, 3, 4, 5""",
    ["wins", "hood", "wcorr", "cuts"])


def dynamic_graphs(spark, d):
    h = X.hourly(spark, d)
    near = cut_lineage(R.top_correlated(train_cells(spark, d), ["fold"], K))
    dense, index = cut_lineage(P.dense_fill(h)), P.hour_index(h)
    return G.dynamic_neighborhood_graphs(dense, index, near, WINDOWS, STRIDE, keys=["fold"])


@query("dynamic_local_graph", X.with_views("dyn", """
    SELECT window_hours, fold, window_end, owner, t, edges, round(edges / pairs, 6) AS edge_density, round(lag(edges / pairs) OVER w, 6) AS edge_density_lag1,
      round(edges / pairs - lag(edges / pairs) OVER w, 6) AS edge_density_delta FROM dyn WINDOW w AS (PARTITION BY window_hours, fold, owner, t ORDER BY window_end)"""))
def dynamic_local_graph(spark, d):
    g = dynamic_graphs(spark, d).withColumnRenamed("window_end", "ts")
    out = FO.lag_and_delta(g, ["window_hours", "fold", "owner", "t"], ["edge_density"]).withColumnRenamed("ts", "window_end")
    return out.select("window_hours", "fold", "window_end", "owner", "t", "edges", r6("edge_density"), r6("edge_density_lag1"), r6("edge_density_delta"))


@query("dynamic_local_graph_features", with_graph(
    "wins hood wcorr cuts", "SELECT window_hours, window_end, fold, owner, t, member AS node FROM (SELECT DISTINCT window_hours, window_end FROM wins), hood, cuts",
    "SELECT w.window_hours, w.window_end, x.fold, x.owner, t, w.a, w.b FROM hood x JOIN hood y ON x.fold = y.fold AND x.owner = y.owner AND x.member < y.member "
    "JOIN wcorr w ON w.a = x.member AND w.b = y.member, cuts WHERE round(abs(w.r), 9) >= t", [*WINDOW, "fold", "owner", "t"]))
def dynamic_local_graph_features(spark, d):
    return r_all(dynamic_graphs(spark, d), "t")
