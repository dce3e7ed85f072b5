"""Queries for train-only scaling, components and forecasters."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import evaluate as E
from tidepanel.operators import fits as T
from tidepanel.operators import folds as FO
from tidepanel.operators import graph as G
from tidepanel.operators import joins as J
from tidepanel.operators import learn as L
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.operators import topology as Y
from tidepanel.plans.graphs import K, neighbours, pca_neighbours, train_cells, train_corr
from tidepanel.plans.registry import query, r6
from tidepanel.plans.scoring import FOLD, r_all
from tidepanel.session import at_once, cut_lineage, spread

X.add_cte("fstate", """
    SELECT g.ts, g.family, avg(p.p) AS mean, median(p.p) AS median, coalesce(stddev_pop(p.p), 0) AS std, CAST(count(p.p) AS DOUBLE) AS n
    FROM (SELECT h.ts, f.family FROM hours h, (SELECT DISTINCT family FROM markets WHERE family IS NOT NULL) f) g
    LEFT JOIN (SELECT panel.ts, panel.p, m.family FROM panel JOIN markets m USING (market_id)) p ON p.ts = g.ts AND p.family = g.family GROUP BY 1, 2""",
    ["hours", "panel", "markets"])
X.add_cte("flong", """
    SELECT ts, family || '__mean' AS feature, mean AS value FROM fstate UNION ALL SELECT ts, family || '__median', median FROM fstate
    UNION ALL SELECT ts, family || '__std', std FROM fstate UNION ALL SELECT ts, family || '__count', n FROM fstate""", ["fstate"])


def family_names(markets):
    """The families of the market table, a few labels, in order."""
    return [r["family"] for r in markets.select("family").where("family IS NOT NULL").distinct().orderBy("family").collect()]


# Rows of a panel from which every core gets its share of them.
MANY_ROWS = 1 << 17


class Setup:
    """Panel, folds and scaled state shared by the queries below, written once per query."""

    def __init__(self, spark, d):
        self.inputs, self.fitted = X.Inputs(spark, d), {}

    # Each table is built and written when a query first asks for it.
    hourly = property(lambda self: self.inputs.hourly)
    markets = property(lambda self: self.inputs.markets)
    cells = property(lambda self: self.inputs.panel)
    index = cached_property(lambda self: P.hour_index(self.hourly))
    folds = cached_property(lambda self: cut_lineage(FO.chronological_folds(self.cells, **FOLD)))
    families = cached_property(lambda self: family_names(self.markets))
    members = cached_property(lambda self: J.fold_hours(self.folds))
    rows = cached_property(lambda self: cut_lineage(self.inputs.supervised))
    many = cached_property(lambda self: self.rows.count() >= MANY_ROWS)
    long = cached_property(lambda self: cut_lineage(L.state_features(P.family_state(self.cells, self.markets), self.index, self.families)))

    def fold_ids(self):
        return [r["fold"] for r in self.folds.select("fold").orderBy("fold").collect()]

    def scaled(self, clip=None):
        """Scaled state of every hour for every fold, fitted on that fold's training hours."""
        train = self.long.join(self.members.where("split = 'train'").select("fold", "ts"), "ts")
        fitted = cut_lineage(L.fit_scale(train, ["fold", "feature"]))
        return L.scale(self.long, fitted, ["feature"], clip)

    def vectors(self, clip=None):
        return cut_lineage(L.state_vectors(self.scaled(clip), ["fold"]))

    def bases(self, vectors):
        """The components of every fold, from one pass over its training hours."""
        train = vectors.join(self.members.where("split = 'train'").select("fold", "ts"), ["fold", "ts"], "left_semi")
        return {int(f): L.components_of(mean, cov) for f, (_, mean, cov) in T.covariances(train, "fold").items()}

    def components(self, vectors, fold):
        if self.fitted.get("of") is not vectors:
            self.fitted = {"of": vectors} | self.bases(vectors)
        return vectors.where(F.col("fold") == fold), self.fitted[fold]

    def each_fold(self, fn, vectors):
        """`fn` of every fold, folds beside each other; what they share is made before them."""
        folds = self.fold_ids()
        self.members, self.many  # noqa: B018
        for fold in folds[:1]:
            self.components(vectors, fold)
        return at_once(self.inputs.spark, fn, folds)

    def modelling_rows(self, fold, vectors=None, k=2):
        """Train and test rows of a fold with the first k component scores."""
        tagged = self.rows.join(self.members.where(F.col("fold") == fold).select("ts", "split"), "ts").withColumn("fold", F.lit(fold))
        if vectors is not None:
            mine, fitted = self.components(vectors, fold)
            scores = mine.select("ts", fitted.scores(F.col("x"), k).alias("s")).select("ts", *[F.col("s")[i].alias(f"pca_{i + 1}") for i in range(k)])
            tagged = tagged.join(scores, "ts")
        # A boosted round is a pass over the rows: many are dealt to every core, few lie where they are written.
        tagged = cut_lineage(spread(tagged) if self.many else tagged)
        return tagged.where("split = 'train'"), tagged.where("split = 'test'")


def scored(preds, *keys):
    return r_all(E.score_predictions(preds, list(keys)))


# --- scaling -----------------------------------------------------------------------------------


@query("fit_impute_scale", X.with_views("flong folds", """
    WITH tr AS (SELECT f.fold, l.* FROM flong l JOIN folds f ON l.ts BETWEEN f.train_start AND f.train_end),
    st AS (SELECT fold, feature, avg(value) AS m FROM tr GROUP BY 1, 2 HAVING count(DISTINCT value) > 1),
    sd AS (SELECT fold, feature, any_value(st.m) AS m, stddev_pop(coalesce(tr.value, st.m)) AS s FROM tr JOIN st USING (fold, feature) GROUP BY 1, 2)
    SELECT fold, l.ts, feature, round((coalesce(l.value, m) - m) / s, 6) AS z FROM flong l JOIN sd USING (feature)"""))
def fit_impute_scale(spark, d):
    return Setup(spark, d).scaled().select("fold", "ts", "feature", r6("z"))


@query("fit_impute_scale_median", X.with_views("flong folds", """
    WITH tr AS (SELECT f.fold, l.* FROM flong l JOIN folds f ON l.ts BETWEEN f.train_start AND f.train_end),
    st AS (SELECT fold, feature, median(value) AS q FROM tr GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
    SELECT fold, feature, round(any_value(q), 6) AS fill, round(avg(coalesce(tr.value, q)), 6) AS mean, round(stddev_pop(coalesce(tr.value, q)), 6) AS std
    FROM tr JOIN st USING (fold, feature) GROUP BY 1, 2"""))
def fit_impute_scale_median(spark, d):
    s = Setup(spark, d)
    train = s.long.join(s.members.where("split = 'train'").select("fold", "ts"), "ts")
    return r_all(L.fit_scale(train, ["fold", "feature"], "median"))


@query("active_fill_scale", X.with_views("panel folds lifemask", """
    WITH lv AS (SELECT f.fold, CASE WHEN l.ts <= f.train_end THEN 'train' ELSE 'test' END AS split, l.ts, l.market_id, p.p FROM lifemask l
      LEFT JOIN panel p ON p.ts = l.ts AND p.market_id = l.market_id JOIN folds f ON l.ts BETWEEN f.train_start AND f.train_end OR l.ts BETWEEN f.test_start AND f.test_end),
    st AS (SELECT fold, market_id, avg(p) AS m, stddev_pop(p) AS s FROM lv WHERE split = 'train' GROUP BY 1, 2 HAVING min(p) < max(p))
    SELECT fold, split, market_id, count(*) AS n, round(sum(coalesce((p - m) / s, 0)), 4) AS total FROM lv JOIN st USING (fold, market_id) GROUP BY 1, 2, 3"""))
def active_fill_scale(spark, d):
    s = Setup(spark, d)
    mask = P.lifetime_mask(P.market_lifetimes(s.hourly, s.markets), s.index)
    z = L.active_fill_scale(s.cells, mask, s.members)
    return z.groupBy("fold", "split", "market_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("total"))


@query("zscore_by_train", X.with_views("tsfeat folds", """
    WITH r AS (SELECT f.fold, CASE WHEN t.ts <= f.train_end THEN 'train' ELSE 'test' END AS split, t.ts, t.feature, t.value FROM
      (SELECT ts, 'f1' AS feature, f1 AS value FROM tsfeat UNION ALL SELECT ts, 'f2', CAST(f2 AS DOUBLE) FROM tsfeat) t
      JOIN folds f ON t.ts BETWEEN f.train_start AND f.test_end)
    SELECT fold, split, ts, feature, round(coalesce((value - avg(value) FILTER (split = 'train') OVER w) / nullif(stddev_pop(value) FILTER (split = 'train') OVER w, 0), 0), 6) AS z
    FROM r WINDOW w AS (PARTITION BY fold, feature)"""))
def zscore_by_train(spark, d):
    s = Setup(spark, d)
    wide = s.cells.groupBy("ts").agg(F.avg("p").alias("f1"), F.count("*").cast("double").alias("f2"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("f1", "f2")])
    rows = wide.select("ts", F.explode(pairs).alias("f")).select("ts", "f.*").join(s.members, "ts")
    return L.zscore_by_train(rows, ["fold", "feature"]).select("fold", "split", "ts", "feature", r6("z"))


@query("balanced_weights", X.with_views("sup folds", """
    SELECT f.fold, round(count(*) / (2.0 * greatest(sum(y), 1)), 6) AS weight_yes, round(count(*) / (2.0 * greatest(count(*) - sum(y), 1)), 6) AS weight_no
    FROM sup s JOIN folds f ON s.ts BETWEEN f.train_start AND f.train_end GROUP BY 1"""))
def balanced_weights(spark, d):
    s = Setup(spark, d)
    return r_all(L.balanced_weights(s.rows.join(s.members.where("split = 'train'"), "ts"), ["fold"]))


# --- components --------------------------------------------------------------------------------


def each_fold(spark, d, fn):
    s = Setup(spark, d)
    v = s.vectors()
    return M.union_models([fn(s, fold, *s.components(v, fold)) for fold in s.fold_ids()])


@query("pca_residuals")
def pca_residuals(spark, d):
    def rest(s, fold, mine, fitted):
        return mine.select("fold", "ts", F.posexplode(fitted.residuals(F.col("x"), 5)).alias("position", "residual"))

    return r_all(each_fold(spark, d, rest))


@query("reconstruction_baselines", X.with_views("panel folds", """
    WITH tr AS (SELECT f.fold, p.market_id, avg(p.p) AS mean_p, arg_max(p.p, p.ts) AS last_p FROM panel p JOIN folds f ON p.ts BETWEEN f.train_start AND f.train_end GROUP BY 1, 2),
    e AS (SELECT f.fold, p.p - tr.mean_p AS em, p.p - tr.last_p AS el FROM panel p JOIN folds f ON p.ts BETWEEN f.test_start AND f.test_end JOIN tr ON tr.fold = f.fold AND tr.market_id = p.market_id)
    SELECT fold, 'train_mean' AS model, count(*) AS n_obs, round(sqrt(avg(em * em)), 6) AS rmse, round(avg(abs(em)), 6) AS mae, round(avg(em), 6) AS bias FROM e GROUP BY 1
    UNION ALL SELECT fold, 'last_train_state', count(*), round(sqrt(avg(el * el)), 6), round(avg(abs(el)), 6), round(avg(el), 6) FROM e GROUP BY 1"""))
def reconstruction_baselines(spark, d):
    s = Setup(spark, d)
    tagged = s.cells.join(s.members, "ts")
    train = tagged.where("split = 'train'").groupBy("fold", "market_id").agg(F.avg("p").alias("train_mean"), F.max_by("p", "ts").alias("last_train_state"))
    guesses = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("v")) for c in ("train_mean", "last_train_state")])
    e = tagged.where("split = 'test'").join(train, ["fold", "market_id"]).select("fold", F.explode(guesses).alias("g"), "p").select(
        "fold", "g.model", (F.col("p") - F.col("g.v")).alias("e"))
    return r_all(e.groupBy("fold", "model").agg(
        F.count("*").alias("n_obs"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias")))


@query("nearest_pca_neighbors")
def nearest_pca_neighbors(spark, d):
    return pca_neighbours(train_cells(spark, d), K).select("fold", "owner", "member", "rank", r6("dist"))


# --- forecasters -------------------------------------------------------------------------------

BASE = ["p", "n_active"]
PCA = [*BASE, "pca_1", "pca_2"]


def run_folds(spark, d, fit, k=2):
    s = Setup(spark, d)
    v = s.vectors()
    told = s.each_fold(lambda fold: fit(s, fold, *s.modelling_rows(fold, v, k)), v)
    return M.union_models([part for parts in told for part in parts])


def tag(result, fold, model):
    keep = ("ts", "market_id", "y", "p_hat")
    return result[0].select(F.lit(fold).alias("fold"), F.lit(model).alias("model"), *keep)


def project(vectors, bases, k):
    """fold, ts and pca_1 .. pca_k: the scores of every hour in its fold's first k components."""
    held = {f: (c.mean, c.loadings[:, :k]) for f, c in bases.items()}
    row = "fold int, ts timestamp_ntz, " + ", ".join(f"pca_{i + 1} double" for i in range(k))

    def run(frames):
        for pdf in frames:
            for fold, at in pdf.groupby("fold").groups.items():
                mean, basis = held[fold]
                scores = (np.vstack(pdf.loc[at, "x"].to_numpy()) - mean) @ basis
                told = pd.DataFrame(np.c_[scores, np.zeros((len(scores), k - scores.shape[1]))], columns=[f"pca_{i + 1}" for i in range(k)])
                told.insert(0, "ts", pdf.loc[at, "ts"].to_numpy())
                told.insert(0, "fold", fold)
                yield told

    return vectors.select("fold", "ts", "x").mapInPandas(run, row)


def fold_design(s, k=2, rows=None):
    """Rows of every fold and split with the fold's component scores."""
    v = s.vectors()
    return spread(s.rows if rows is None else rows).join(s.members, "ts").join(cut_lineage(project(v, s.bases(v), k)), ["fold", "ts"])


KEEP = ["fold", "ts", "market_id", "y"]


@query("logistic_forecast")
def logistic_forecast(spark, d):
    """The price against the price and two components, plain and with balanced classes: all folds fitted together."""
    s = Setup(spark, d)
    fits = [T.Fit("pca_standard", tuple(PCA), 0.01), T.Fit("pca_balanced", tuple(PCA), 0.01, balanced=True)]
    fitted = T.Fitted(T.Design(fold_design(s), ["fold"], PCA, KEEP), fits)
    market = s.rows.join(s.members.where("split = 'test'"), "ts").select("fold", F.lit("market").alias("model"), "ts", "market_id", F.col("y").cast("double").alias("y"), F.col("p").alias("p_hat"))
    return scored(market.unionByName(fitted.tested()), "fold", "model")


TARGETS = ("abs_move_24h", "abs_move_72h", "abs_error", "squared_error")


@query("ridge_forecast")
def ridge_forecast(spark, d):
    """Ridge fits of the coming moves and of the price's error, every fold and target fitted together."""
    s = Setup(spark, d)
    # A row's targets are the same in every fold, so they are met before the folds multiply the rows.
    rows = fold_design(s, rows=P.future_targets(s.rows, s.cells))
    targets = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("v")) for t in TARGETS])
    rows = rows.withColumn("t", F.explode(targets)).where("t.v IS NOT NULL").withColumns({"target": F.col("t.target"), "y": F.col("t.v")}).drop("t")
    fitted = T.Fitted(T.Design(rows, ["fold", "target"], PCA, ["fold", "target", "ts", "market_id", "y"]), [T.Fit("ridge_pca", tuple(PCA), 1.0, "ridge")])
    told = fitted.predictions(fitted.design.raw.where("split = 'test'"))
    return r_all(E.score_regression(told, ["fold", "target"], "y", "hat"))


@query("boosted_trees_forecast")
def boosted_trees_forecast(spark, d):
    def fit(s, fold, train, test):
        got = L.forecast(train, test, PCA, kind="trees", scaled=False)
        return [tag(got, fold, "trees_pca")] if got else []

    return scored(run_folds(spark, d, fit), "fold", "model")


@query("feature_importance")
def feature_importance(spark, d):
    """Importances of the boosted trees in every fold, and their mean over folds."""
    s = Setup(spark, d)
    v = s.vectors()
    cols = [*BASE, *[f"pca_{i}" for i in range(1, 6)]]

    def told(fold):
        got = L.forecast(*s.modelling_rows(fold, v, 5), cols, kind="trees", scaled=False)
        return [(fold, c, float(x)) for c, x in zip(cols, got[1].featureImportances.toArray())] if got else []

    rows = [r for part in s.each_fold(told, v) for r in part]
    out = spark.createDataFrame(rows, "fold int, feature string, importance double")
    mean = out.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return r_all(FO.top_n_per_group(out.join(mean, "feature"), ["fold"], [F.round("importance", 9).desc(), F.col("feature")], 20))


@query("coefficient_effects")
def coefficient_effects(spark, d):
    """Coefficients of the columns as they are, and what a training deviation of each does: folds fitted beside each other."""
    s = Setup(spark, d)
    design = cut_lineage(fold_design(s))

    def fit(fold):
        train, test = (design.where((F.col("fold") == fold) & (F.col("split") == part)) for part in ("train", "test"))
        model = L.forecast(train, test, PCA, scaled=False)[1]
        sd = train.agg(*[F.stddev_pop(c).alias(c) for c in PCA]).first()
        return [(fold, c, float(b), float(b * sd[c])) for c, b in zip(PCA, model.coefficients.toArray())]

    rows = [r for part in at_once(spark, fit, s.fold_ids()) for r in part]
    out = spark.createDataFrame(rows, "fold int, feature string, coef double, effect double").groupBy("feature").agg(
        F.avg("coef").alias("mean_coef"), F.avg("effect").alias("mean_effect"), F.count("*").alias("folds"))
    own = out.where("feature = 'p'").agg(F.max("mean_effect")).scalar()
    return r_all(out.withColumn("ratio_to_p", F.abs(F.col("mean_effect") / F.nullif(own, F.lit(0.0)))))


def fold_topology(s, vectors, fold, window=24, stride=12):
    mine = vectors.where(F.col("fold") == fold)
    points = cut_lineage(Y.window_points(mine.select("ts", "x"), s.index, window, stride))
    keys = ["window_hours", "window_end"]
    dgms = cut_lineage(Y.persistence_diagrams(points, keys))
    return points, dgms, keys


WINDOW_KEYS = ["fold", "window_hours", "window_end"]


def folds_topology(s, vectors, window=24, stride=12):
    """Points and diagrams of every fold's windows."""
    points = cut_lineage(Y.window_points(vectors.select("fold", "ts", "x"), s.index, window, stride))
    return points, cut_lineage(Y.persistence_diagrams(points, WINDOW_KEYS))


def logit_folds(s, rows, models, vectors=None):
    """Scores of a logistic fit of every fold and model, its columns named by `models`; rows are written once, and a fold's columns scaled once for all its models."""
    rows = cut_lineage(rows)
    cols = [*dict.fromkeys(c for used in models.values() for c in used)]

    def prepare(fold):
        train, test = (rows.where((F.col("fold") == fold) & (F.col("split") == part)) for part in ("train", "test"))
        return None if L.one_class(train) else [cut_lineage(part) for part in L.standardise(train, [train, test], cols)]

    def fit(job):
        (fold, parts), name = job
        return tag(L.forecast(*parts, [f"{c}__z" for c in models[name]], c=0.01, vectors=vectors, scaled=False), fold, name)

    folds = s.fold_ids()
    ready = [(fold, parts) for fold, parts in zip(folds, at_once(s.inputs.spark, prepare, folds)) if parts]
    told = at_once(s.inputs.spark, fit, [(part, name) for part in ready for name in models])
    return scored(M.union_models(told), "fold", "model")


@query("image_logistic")
def image_logistic(spark, d):
    """Logistic model on the price and the persistence image of the latest window: windows of all folds in one job, fits beside each other."""
    s = Setup(spark, d)
    points, dgms = folds_topology(s, s.vectors(10.0))
    loops = dgms.where("dim = 1")
    last = s.members.where("split = 'train'").groupBy("fold").agg(F.max("ts").alias("last"))
    limits = cut_lineage(Y.image_ranges(loops.join(last, "fold").where("window_end <= last"), ["fold", "window_hours"]))
    image = Y.persistence_image(Y.birth_persistence(loops).join(limits, ["fold", "window_hours"]), WINDOW_KEYS, 10, 0.5)
    vec = cut_lineage(Y.image_vectors(image, points, WINDOW_KEYS, 10).select("fold", F.col("window_end").alias("ts"), F.col("features").alias("image")))
    hours = cut_lineage(J.asof_backward(s.members, vec, ["image"], by=["fold"]).where("image IS NOT NULL"))
    rows = spread(s.rows).join(hours, "ts").select(*KEEP, "split", *BASE, "image")
    return logit_folds(s, rows, {"image_24h": BASE}, ["image"])


@query("ablation_groups")
def ablation_groups(spark, d):
    """The same forecast with each group of topology and neighbourhood features on its own: windows of all folds in one job, fits beside each other."""
    s = Setup(spark, d)
    live = train_cells(spark, d)
    corr = train_corr(live)
    near = neighbours(corr)
    graph = G.neighborhood_graphs(near, corr, ["fold"]).where("t = 0.5").select("fold", F.col("owner").alias("market_id"), "edge_density", "clustering")
    ctrl = G.neighborhood_controls(near, corr, keys=["fold"]).withColumnRenamed("owner", "market_id")
    side = cut_lineage(graph.join(ctrl, ["fold", "market_id"]))
    h0, h1 = Y.stat_columns()[:4], Y.stat_columns()[4:]
    groups = {"h0": h0, "h1": h1, "h0_h1": h0 + h1, "edge_density": ["edge_density"], "clustering": ["clustering"],
              "controls": ["corr_mean_abs", "corr_std_abs", "prob_mean", "prob_std"]}
    points, dgms = folds_topology(s, s.vectors(10.0))
    stats = cut_lineage(Y.diagram_stats(dgms, points, WINDOW_KEYS).withColumnRenamed("window_end", "ts"))
    hours = cut_lineage(J.asof_backward(s.members, stats, h0 + h1, by=["fold"]))
    rows = fold_design(s).join(hours, ["fold", "split", "ts"], "left").join(side, ["fold", "market_id"], "left")
    return logit_folds(s, rows, {f"pca_{name}": [*PCA, *extra] for name, extra in groups.items()})


@query("kmeans_silhouette")
def kmeans_silhouette(spark, d):
    s = Setup(spark, d)
    v = s.vectors()
    rows = [(fold, *r) for fold in s.fold_ids() for r in L.best_silhouette(v.where(F.col("fold") == fold))]
    out = spark.createDataFrame(rows, "fold int, k int, silhouette double")
    best = out.groupBy("fold").agg(F.max("silhouette").alias("best"))
    return r_all(out.join(best, "fold").withColumn("is_best", F.col("silhouette") == F.col("best")).drop("best"))


@query("trajectory_stats", X.with_views("fstate", """
    WITH c AS (SELECT ts, max(CASE WHEN family = 'BUILDING' THEN coalesce(mean, 0.5) END) AS x, max(CASE WHEN family = 'HOUSEHOLD' THEN coalesce(mean, 0.5) END) AS y,
      max(CASE WHEN family = 'MACHINERY' THEN coalesce(mean, 0.5) END) AS z FROM fstate GROUP BY 1),
    s AS (SELECT sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM c WINDOW w AS (ORDER BY ts)),
    r AS (SELECT sqrt((x - avg(x) OVER ()) ** 2 + (y - avg(y) OVER ()) ** 2 + (z - avg(z) OVER ()) ** 2) AS radius FROM c),
    q AS (SELECT quantile_cont(radius, 0.99) AS p99, median(radius) AS med FROM r),
    e AS (SELECT sqrt((arg_min(x, ts) - arg_max(x, ts)) ** 2 + (arg_min(y, ts) - arg_max(y, ts)) ** 2 + (arg_min(z, ts) - arg_max(z, ts)) ** 2) AS far FROM c)
    SELECT round(e.far, 6) AS start_end_distance, round((SELECT median(step) FROM s), 6) AS median_step, round((SELECT quantile_cont(step, 0.95) FROM s), 6) AS p95_step,
      round(q.med, 6) AS median_radius, (SELECT count(*) FROM r WHERE radius > q.p99) AS outliers_past_p99, round(e.far / q.med, 6) AS start_end_radius_ratio FROM e, q"""))
def trajectory_stats(spark, d):
    s = Setup(spark, d)
    mean = lambda f: F.coalesce(F.max(F.when(F.col("feature") == f"{f}__mean", F.col("value"))), F.lit(0.5))
    coords = s.long.groupBy("ts").agg(F.array(mean("BUILDING"), mean("HOUSEHOLD"), mean("MACHINERY")).alias("x"))
    return r_all(L.trajectory_stats(coords))
