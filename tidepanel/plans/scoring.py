"""Queries for folds, placebos, selection and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import evaluate as E
from tidepanel.operators import folds as FO
from tidepanel.operators import joins as J
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.operators import quality as Q
from tidepanel.plans.panels import CORE, CORE_SQL, SATELLITE
from tidepanel.plans.registry import query, r6
from tidepanel.session import cut_lineage

FOLD = {"initial": 0.60, "test": 48, "step": 48, "min_test": 24}
SATELLITE_SQL = "(" + ", ".join(f"'{f}'" for f in SATELLITE) + ")"
INNER = {"fraction": 0.20, "min_train": 240, "min_val": 48}

X.add_cte("idx", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel)", ["panel"])
X.add_cte("folds", """
    SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS fold, a.ts AS train_start, b.ts AS train_end, c.ts AS test_start, d.ts AS test_end
    FROM (SELECT s, least(s + 48, n) AS stop FROM (SELECT n, unnest(generate_series(CAST(floor(n * 0.60) AS BIGINT), n - 1, 48)) AS s
          FROM (SELECT max(n) AS n FROM idx)) WHERE least(s + 48, n) - s >= 24) q
    JOIN idx a ON a.i = 0 JOIN idx b ON b.i = q.s - 1 JOIN idx c ON c.i = q.s JOIN idx d ON d.i = q.stop - 1""", ["idx"])
X.add_cte("preds", """
    SELECT f.fold, s.*, m.model, greatest(1e-6, least(1 - 1e-6, CASE m.model WHEN 'market' THEN s.p WHEN 'shrunk' THEN 0.8 * s.p + 0.1
      WHEN 'sharp' THEN s.p * s.p / (s.p * s.p + (1 - s.p) * (1 - s.p)) ELSE 0.5 * s.p + 0.5 * g.prior END)) AS p_hat
    FROM sup s JOIN folds f ON s.ts BETWEEN f.test_start AND f.test_end
    JOIN (SELECT family, avg(y) AS prior FROM markets GROUP BY 1) g USING (family)
    CROSS JOIN (SELECT unnest(['market', 'shrunk', 'sharp', 'prior']) AS model) m""", ["sup", "folds", "markets"])


def folds(spark, d, cells=None):
    return FO.chronological_folds(X.active_panel(spark, d) if cells is None else cells, **FOLD)


def predictions(spark, d):
    """Four probability models on the test rows of every fold; whoever reads them twice writes them."""
    cells = X.active_panel(spark, d)
    m = X.markets(spark, d)
    rows = P.supervised_rows(cells, m)
    prior = m.groupBy("family").agg(F.avg("y").alias("prior"))
    test = J.fold_rows(rows, folds(spark, d, cells), "test").drop("split").join(prior, "family")
    p = F.col("p")
    models = F.array(*[F.struct(F.lit(n).alias("model"), v.alias("v")) for n, v in (
        ("market", p), ("shrunk", 0.8 * p + 0.1), ("sharp", p * p / (p * p + (1 - p) * (1 - p))), ("prior", 0.5 * p + 0.5 * F.col("prior")))])
    return test.withColumn("m", F.explode(models)).withColumns({"model": F.col("m.model"), "p_hat": E.probability_clip("m.v")}).drop("m", "prior")


def r_all(df, *skip):
    return df.withColumns({c: r6(c) for c, t in df.dtypes if t == "double" and c not in skip})


SCORES = """count(*) AS n_obs, round(avg((p_hat - y) * (p_hat - y)), 6) AS brier, round(avg(-(y * ln(p_hat) + (1 - y) * ln(1 - p_hat))), 6) AS log_loss,
      round(avg(p_hat), 6) AS avg_pred, round(avg(y), 6) AS avg_actual"""

# --- folds -------------------------------------------------------------------------------------


@query("chronological_folds", X.with_views("folds", "SELECT * FROM folds"))
def chronological_folds(spark, d):
    return folds(spark, d)


@query("locked_holdout", X.with_views("idx", """
    SELECT 999 AS fold, min(ts) FILTER (i = 0) AS train_start, max(ts) FILTER (i = cut - 1) AS train_end,
      max(ts) FILTER (i = cut) AS test_start, max(ts) AS test_end FROM (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS cut FROM idx)"""))
def locked_holdout(spark, d):
    return FO.locked_holdout(X.active_panel(spark, d))


X.add_cte("inner_folds", """
    SELECT q.fold, a.ts AS train_start, b.ts AS train_end, c.ts AS test_start, q.train_end AS test_end
    FROM (SELECT fold, train_end, greatest(240, least(CAST(floor((i + 1) * 0.8) AS BIGINT), i + 1 - 48)) AS cut
          FROM folds JOIN idx ON idx.ts = folds.train_end) q
    JOIN idx a ON a.i = 0 JOIN idx b ON b.i = q.cut - 1 JOIN idx c ON c.i = q.cut""", ["folds", "idx"])


@query("inner_validation_fold", X.with_views("inner_folds", "SELECT * FROM inner_folds"))
def inner_validation_fold(spark, d):
    cells = X.active_panel(spark, d)
    return FO.inner_validation(cells, folds(spark, d, cells), **INNER)


@query("range_join_folds", X.with_views("sup folds", """
    SELECT f.fold, 'train' AS split, s.ts, s.market_id, round(s.p, 6) AS p FROM sup s JOIN folds f ON s.ts BETWEEN f.train_start AND f.train_end
    UNION ALL SELECT f.fold, 'test', s.ts, s.market_id, round(s.p, 6) FROM sup s JOIN folds f ON s.ts BETWEEN f.test_start AND f.test_end"""))
def range_join_folds(spark, d):
    cells = X.active_panel(spark, d)
    rows = P.supervised_rows(cells, X.markets(spark, d))
    return J.fold_rows(rows, folds(spark, d, cells)).select("fold", "split", "ts", "market_id", r6("p"))


@query("supervised_rows_fold", X.with_views("sup folds markets", """
    SELECT f.fold, 'train' AS split, count(*) AS n, round(sum(s.p), 6) AS total FROM sup s JOIN markets m USING (market_id)
      JOIN folds f ON s.ts BETWEEN f.train_start AND f.train_end AND m.close_ts <= f.train_end GROUP BY 1
    UNION ALL SELECT f.fold, 'test', count(*), round(sum(s.p), 6) FROM sup s JOIN folds f ON s.ts BETWEEN f.test_start AND f.test_end GROUP BY 1"""))
def supervised_rows_fold(spark, d):
    cells = X.active_panel(spark, d)
    m, f = X.markets(spark, d), folds(spark, d, cells)
    out = FO.supervised_fold_rows(P.supervised_rows(cells, m), J.fold_hours(f), m, f, known_labels_only=True)
    return out.groupBy("fold", "split").agg(F.count("*").alias("n"), r6(F.sum("p"), "total"))


@query("fold_feature_columns", X.with_views("panel folds", """
    SELECT f.fold, p.market_id AS feature, count(*) AS observed FROM panel p JOIN folds f ON p.ts BETWEEN f.train_start AND f.train_end
    GROUP BY 1, 2 HAVING count(DISTINCT p.p) > 1"""))
def fold_feature_columns(spark, d):
    cells = X.active_panel(spark, d)
    long = cells.select("ts", F.col("market_id").alias("feature"), F.col("p").alias("value"))
    return FO.fold_feature_columns(long, J.fold_hours(folds(spark, d, cells)))


@query("class_balance", X.with_views("sup folds", f"""
    WITH r AS (SELECT f.fold, s.* FROM sup s JOIN folds f ON s.ts BETWEEN f.test_start AND f.test_end),
    s AS (SELECT 'overall' AS slice_type, 'overall' AS slice_value, * FROM r UNION ALL SELECT 'family', family, * FROM r
      UNION ALL SELECT 'domain', domain, * FROM r UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), * FROM r
      UNION ALL SELECT 'core_satellite', CASE WHEN family IN {CORE_SQL} THEN 'core' WHEN family IN {SATELLITE_SQL} THEN 'satellite' ELSE 'other' END, * FROM r
      UNION ALL SELECT 'panel', 'core', * FROM r WHERE family IN {CORE_SQL}
      UNION ALL SELECT 'panel', 'core_plus_satellites', * FROM r WHERE family IN {CORE_SQL} OR family IN {SATELLITE_SQL}),
    m AS (SELECT slice_type, slice_value, market_id, max(y) AS y, count(*) AS n, sum(y) AS yes FROM s GROUP BY 1, 2, 3)
    SELECT slice_type, slice_value, count(*) AS markets, CAST(sum(y) AS BIGINT) AS yes_markets, round(avg(y), 6) AS market_yes_rate,
      CAST(sum(n) AS BIGINT) AS rows, CAST(sum(yes) AS BIGINT) AS yes_rows, round(sum(yes) / sum(n), 6) AS row_yes_rate FROM m GROUP BY 1, 2"""))
def class_balance(spark, d):
    cells = X.active_panel(spark, d)
    rows = J.fold_rows(P.supervised_rows(cells, X.markets(spark, d)), folds(spark, d, cells), "test")
    return r_all(Q.class_balance(rows, CORE, SATELLITE))


@query("skip_degenerate", X.with_views("sup folds", """
    WITH r AS (SELECT f.fold, s.family, f.train_end, s.ts, s.y FROM sup s JOIN folds f ON s.ts BETWEEN f.train_start AND f.test_end),
    c AS (SELECT fold, family, count(*) FILTER (ts <= train_end) AS train_rows, count(*) FILTER (ts > train_end) AS test_rows,
      count(DISTINCT y) FILTER (ts <= train_end) AS classes FROM r GROUP BY 1, 2)
    SELECT fold, family, train_rows, test_rows, CASE WHEN train_rows = 0 OR test_rows = 0 THEN 'skipped:empty_train_or_test'
      WHEN classes < 2 THEN 'skipped:single_class_train_labels' ELSE 'ok' END AS status FROM c"""))
def skip_degenerate(spark, d):
    cells = X.active_panel(spark, d)
    rows = J.fold_rows(P.supervised_rows(cells, X.markets(spark, d)), folds(spark, d, cells))
    counts = rows.groupBy("fold", "family").agg(
        F.count_if(F.expr("split = 'train'")).alias("train_rows"), F.count_if(F.expr("split = 'test'")).alias("test_rows"),
        F.min(F.when(F.col("split") == "train", F.col("y"))).alias("lo"), F.max(F.when(F.col("split") == "train", F.col("y"))).alias("hi"))
    status = F.when((F.col("train_rows") == 0) | (F.col("test_rows") == 0), "skipped:empty_train_or_test") \
        .when(F.col("lo") == F.col("hi"), "skipped:single_class_train_labels").otherwise("ok")
    return counts.select("fold", "family", "train_rows", "test_rows", status.alias("status"))


# --- placebos ----------------------------------------------------------------------------------

X.add_cte("tsfeat", "SELECT ts, avg(p) AS f1, count(*) AS f2 FROM panel GROUP BY 1", ["panel"])


def tsfeat(spark, d):
    return X.active_panel(spark, d).groupBy("ts").agg(F.avg("p").alias("f1"), F.count("*").alias("f2"))


@query("placebo_shuffle", X.with_views("tsfeat", """
    SELECT a.ts, round(b.f1, 6) AS f1, b.f2 FROM (SELECT ts, row_number() OVER (ORDER BY hk, ts) AS r FROM (SELECT ts, 0 AS hk FROM tsfeat)) a
    JOIN (SELECT f1, f2, row_number() OVER (ORDER BY md5('7:' || strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS r FROM tsfeat) b USING (r)"""))
def placebo_shuffle(spark, d):
    frame = cut_lineage(tsfeat(spark, d))
    return FO.placebo_shuffle(frame, ["f1", "f2"], 7, "ts").select("ts", r6("f1"), "f2")


@query("placebo_shuffle_within_ts", X.with_views("sup", """
    SELECT a.ts, a.market_id, round(b.p, 6) AS p, round(b.volume, 6) AS volume
    FROM (SELECT ts, market_id, row_number() OVER (PARTITION BY ts ORDER BY market_id) AS r FROM sup) a
    JOIN (SELECT ts, p, volume, row_number() OVER (PARTITION BY ts ORDER BY md5('7:' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ':' || market_id)) AS r
          FROM sup) b USING (ts, r)"""))
def placebo_shuffle_within_ts(spark, d):
    frame = cut_lineage(X.supervised(spark, d))
    return FO.placebo_shuffle(frame, ["p", "volume"], 7, "market_id", within=["ts"]).select("ts", "market_id", r6("p"), r6("volume"))


@query("placebo_future_shift", X.with_views("tsfeat sup", """
    SELECT s.ts, s.market_id, round(f.f1, 6) AS f1 FROM sup s JOIN tsfeat f ON f.ts = s.ts + INTERVAL 24 HOUR"""))
def placebo_future_shift(spark, d):
    later = FO.placebo_future_shift(tsfeat(spark, d), 24)
    return X.supervised(spark, d).join(later, "ts").select("ts", "market_id", r6("f1"))


@query("leakage_diagnostic", X.with_views("panel folds", """
    SELECT f.fold, min(p.ts) AS source_start, max(p.ts) AS source_end, max(p.ts) >= any_value(f.test_start) AS used_test_timestamps
    FROM folds f JOIN panel p ON p.ts BETWEEN f.train_start AND f.train_end OR (f.fold % 2 = 0 AND p.ts BETWEEN f.test_start AND f.test_end) GROUP BY 1"""))
def leakage_diagnostic(spark, d):
    cells = X.active_panel(spark, d)
    f = folds(spark, d, cells)
    used = J.fold_rows(cells, f).where("split = 'train' OR fold % 2 = 0")
    return FO.leakage_diagnostic(used, f)


# --- selection ---------------------------------------------------------------------------------

GRIDS = [
    {"representation": "pca_only", "pca_setting": ["fixed_2", "fixed_5", "var_85"], "c_value": [1.0, 0.1, 0.01]},
    {"representation": "tda_only", "tda_window": [24, 72], "tda_group": ["h0_h1"], "c_value": [1.0, 0.1, 0.01]},
    {"representation": "pca_plus_tda", "pca_setting": ["fixed_2", "fixed_5", "var_85"], "tda_window": [24, 72], "tda_group": ["h0_h1"], "c_value": [1.0, 0.1, 0.01]},
]


@query("model_config_grid", X.with_views("folds", """
    WITH p AS (SELECT unnest(['fixed_2', 'fixed_5', 'var_85']) AS pca_setting), w AS (SELECT unnest([24, 72]) AS tda_window),
    c AS (SELECT unnest([1.0, 0.1, 0.01]) AS c_value, unnest(['1', '0.1', '0.01']) AS ct)
    SELECT fold, 'pca_only' AS representation, pca_setting, 0 AS tda_window, 'none' AS tda_group, CAST(c_value AS DOUBLE) AS c_value,
      'pca_only_' || pca_setting || '_C' || ct AS model FROM folds, p, c
    UNION ALL SELECT fold, 'tda_only', 'none', tda_window, 'h0_h1', CAST(c_value AS DOUBLE), 'tda_only_' || tda_window || 'h_h0_h1_C' || ct FROM folds, w, c
    UNION ALL SELECT fold, 'pca_plus_tda', pca_setting, tda_window, 'h0_h1', CAST(c_value AS DOUBLE),
      'pca_plus_tda_' || pca_setting || '_' || tda_window || 'h_h0_h1_C' || ct FROM folds, p, w, c"""))
def model_config_grid(spark, d):
    return FO.model_config_grid(folds(spark, d), GRIDS)


X.add_cte("trials", """
    SELECT f.fold, g.representation, c.strength, count(*) AS n_obs,
      avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg((q - y) * (q - y)) AS brier
    FROM (SELECT f.fold, g.representation, c.strength, s.y, (1 - c.strength) * s.p + c.strength * g.v AS q
      FROM sup s JOIN inner_folds f ON s.ts BETWEEN f.test_start AND f.test_end
      CROSS JOIN (SELECT unnest(['even', 'low']) AS representation, unnest([0.5, 0.2]) AS v) g
      CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS strength) c) x
    JOIN (SELECT DISTINCT fold FROM inner_folds) f USING (fold) JOIN (SELECT unnest(['even', 'low']) AS representation) g USING (representation)
    JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS strength) c USING (strength) GROUP BY 1, 2, 3""", ["sup", "inner_folds"])
X.add_cte("selected", """
    SELECT fold, representation, strength, n_obs, log_loss, brier FROM (SELECT *, row_number() OVER (PARTITION BY fold, representation
      ORDER BY round(log_loss, 9), round(brier, 9), strength) AS rn FROM trials) WHERE rn = 1""", ["trials"])


def selected(spark, d):
    """Blends of the price with a fixed level, scored on each fold's validation part."""
    cells = X.active_panel(spark, d)
    inner = FO.inner_validation(cells, folds(spark, d, cells), **INNER)
    rows = J.fold_rows(P.supervised_rows(cells, X.markets(spark, d)), inner, "test")
    levels = F.array(*[F.struct(F.lit(n).alias("representation"), F.lit(v).alias("v")) for n, v in (("even", 0.5), ("low", 0.2))])
    tried = rows.withColumn("g", F.explode(levels)).withColumn("strength", F.explode(F.array(*[F.lit(s) for s in (0.1, 0.3, 0.5, 0.7)])))
    s = F.col("strength")
    tried = tried.select("fold", "g.representation", "strength", "y", ((1 - s) * F.col("p") + s * F.col("g.v")).alias("p_hat"))
    scores = E.score_predictions(tried, ["fold", "representation", "strength"]).select("fold", "representation", "strength", "n_obs", "log_loss", "brier")
    return FO.best_per_group(scores, ["fold", "representation"], [F.round("log_loss", 9), F.round("brier", 9), F.col("strength")])


@query("select_config", X.with_views("selected", """
    SELECT fold, representation, CAST(strength AS DOUBLE) AS strength, n_obs, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM selected"""))
def select_config(spark, d):
    return r_all(selected(spark, d))


@query("choose_locked_config", X.with_views("selected", """
    SELECT representation, CAST(strength AS DOUBLE) AS strength, selected_folds, round(l, 6) AS mean_validation_log_loss, round(b, 6) AS mean_validation_brier
    FROM (SELECT *, row_number() OVER (PARTITION BY representation ORDER BY selected_folds DESC, round(l, 9), round(b, 9), strength) AS rn
      FROM (SELECT representation, strength, count(DISTINCT fold) AS selected_folds, avg(log_loss) AS l, avg(brier) AS b FROM selected GROUP BY 1, 2)) WHERE rn = 1"""))
def choose_locked_config(spark, d):
    return r_all(FO.choose_locked_config(selected(spark, d), ["strength"]))


# --- evaluation --------------------------------------------------------------------------------


@query("score_predictions", X.with_views("preds", f"SELECT fold, model, {SCORES} FROM preds GROUP BY 1, 2"))
def score_predictions(spark, d):
    return r_all(E.score_predictions(predictions(spark, d), ["fold", "model"]))


X.add_cte("auc", """
    SELECT fold, model, CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2) / (np * nn) END AS auc FROM (
      SELECT fold, model, sum(CASE WHEN y = 1 THEN r END) AS rs, sum(y) AS np, sum(1 - y) AS nn FROM (
        SELECT *, rank() OVER (PARTITION BY fold, model ORDER BY p_hat) + (count(*) OVER (PARTITION BY fold, model, p_hat) - 1) / 2.0 AS r FROM preds)
      GROUP BY 1, 2)""", ["preds"])


@query("score_auc", X.with_views("auc", "SELECT fold, model, round(auc, 6) AS auc FROM auc"))
def score_auc(spark, d):
    return r_all(E.score_auc(predictions(spark, d), ["fold", "model"]))


@query("score_regression", X.with_views("sup panel", """
    SELECT s.family, count(*) AS n_obs, round(avg((b.p - s.p) * (b.p - s.p)), 6) AS mse, round(avg(abs(b.p - s.p)), 6) AS mae
    FROM sup s JOIN panel b ON b.market_id = s.market_id AND b.ts = s.ts + INTERVAL 24 HOUR GROUP BY 1"""))
def score_regression(spark, d):
    rows = P.shift_join((x := X.Inputs(spark, d)).supervised, x.panel, 24, "later")
    return r_all(E.score_regression(rows, ["family"], "later", "p"))


ACTIVE_SQL = "CASE WHEN n_active <= 10 THEN '<=10' WHEN n_active <= 25 THEN '11-25' WHEN n_active <= 50 THEN '26-50' WHEN n_active <= 100 THEN '51-100' ELSE '>100' END"
PROB_SQL = """CASE WHEN p <= 0.05 THEN '0-5%' WHEN p <= 0.10 THEN '5-10%' WHEN p <= 0.25 THEN '10-25%' WHEN p <= 0.50 THEN '25-50%'
    WHEN p <= 0.75 THEN '50-75%' WHEN p <= 0.90 THEN '75-90%' WHEN p <= 0.95 THEN '90-95%' ELSE '95-100%' END"""


@query("active_count_bucket", X.with_views("sup", f"SELECT {ACTIVE_SQL} AS bucket, count(*) AS n FROM sup GROUP BY 1"))
def active_count_bucket(spark, d):
    return X.supervised(spark, d).groupBy(E.active_count_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("prob_bucket", X.with_views("sup", f"SELECT {PROB_SQL} AS bucket, count(*) AS n, round(avg(y), 6) AS yes_rate FROM sup GROUP BY 1"))
def prob_bucket(spark, d):
    return X.supervised(spark, d).groupBy(E.prob_bucket().alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("y"), "yes_rate"))


@query("result_slices", X.with_views("preds", f"""
    WITH s AS (SELECT 'overall' AS slice_type, 'overall' AS slice_value, * FROM preds UNION ALL SELECT 'domain', domain, * FROM preds
      UNION ALL SELECT 'family', family, * FROM preds UNION ALL SELECT 'y', CAST(y AS VARCHAR), * FROM preds
      UNION ALL SELECT 'active_count_bucket', {ACTIVE_SQL}, * FROM preds UNION ALL SELECT 'prob_bucket', {PROB_SQL}, * FROM preds),
    k AS (SELECT *, rank() OVER (PARTITION BY slice_type, slice_value, fold, model ORDER BY p_hat)
      + (count(*) OVER (PARTITION BY slice_type, slice_value, fold, model, p_hat) - 1) / 2.0 AS r FROM s)
    SELECT fold, model, slice_type, slice_value, {SCORES}, round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
      (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END, 6) AS auc FROM k GROUP BY 1, 2, 3, 4"""))
def result_slices(spark, d):
    return r_all(E.result_slices(predictions(spark, d), ["fold", "model"]))


DECILE_SQL = "list_sum([CAST(p_hat > i * CAST(0.1 AS DOUBLE) AS INTEGER) for i in [1, 2, 3, 4, 5, 6, 7, 8, 9]])"
X.add_cte("deciles", f"""
    SELECT fold, model, CAST({DECILE_SQL} AS INTEGER) AS prob_decile, count(*) AS n_obs, avg(p_hat) AS avg_pred, avg(y) AS avg_actual
    FROM preds GROUP BY 1, 2, 3""", ["preds"])


@query("calibration_deciles", X.with_views("deciles", """
    SELECT fold, model, prob_decile, n_obs, round(avg_pred, 6) AS avg_pred, round(avg_actual, 6) AS avg_actual FROM deciles"""))
def calibration_deciles(spark, d):
    return r_all(E.calibration_deciles(predictions(spark, d), ["fold", "model"]))


@query("expected_calibration_error", X.with_views("deciles", """
    SELECT fold, model, round(sum(n_obs * abs(avg_pred - avg_actual)) / sum(n_obs), 6) AS ece FROM deciles GROUP BY 1, 2"""))
def expected_calibration_error(spark, d):
    return r_all(E.expected_calibration_error(predictions(spark, d), ["fold", "model"]))


X.add_cte("fscores", """
    SELECT fold, model, count(*) AS n_obs, avg((p_hat - y) * (p_hat - y)) AS brier, avg(-(y * ln(p_hat) + (1 - y) * ln(1 - p_hat))) AS log_loss,
      avg(p_hat) AS avg_pred, avg(y) AS avg_actual FROM preds GROUP BY 1, 2""", ["preds"])


def fold_scores(spark, d):
    """Scores per fold and model, a few rows that are written for whoever compares them with each other."""
    return cut_lineage(E.score_predictions(predictions(spark, d), ["fold", "model"]))


@query("model_leaderboard", X.with_views("fscores auc", """
    SELECT model, count(DISTINCT fold) AS folds, CAST(sum(n_obs) AS BIGINT) AS n_obs, round(avg(log_loss), 6) AS fold_mean_log_loss,
      round(avg(brier), 6) AS fold_mean_brier, round(avg(avg_pred), 6) AS fold_mean_avg_pred, round(avg(avg_actual), 6) AS fold_mean_avg_actual,
      round(avg(auc), 6) AS fold_mean_auc FROM fscores JOIN auc USING (fold, model) GROUP BY 1"""))
def model_leaderboard(spark, d):
    return r_all(E.model_leaderboard(E.scores_of_counts(predictions(spark, d), ["fold", "model"])))


@query("fold_decomposition", X.with_views("fscores", """
    SELECT fold, round(b.log_loss - c.log_loss, 6) AS log_loss_gain, round(b.brier - c.brier, 6) AS brier_gain,
      round(c.avg_pred - b.avg_pred, 6) AS calibration_shift, b.log_loss - c.log_loss > 0 AS helped
    FROM (SELECT * FROM fscores WHERE model = 'prior') c JOIN (SELECT * FROM fscores WHERE model = 'market') b USING (fold)"""))
def fold_decomposition(spark, d):
    return r_all(E.fold_decomposition(fold_scores(spark, d), "prior", "market"))


@query("baseline_delta_join", X.with_views("fscores", """
    SELECT s.fold, s.model, round(s.log_loss - b.log_loss, 6) AS log_loss_delta, round(s.brier - b.brier, 6) AS brier_delta
    FROM fscores s JOIN fscores b ON s.fold = b.fold AND b.model = 'market' WHERE s.model <> 'market'"""))
def baseline_delta_join(spark, d):
    out = J.baseline_delta(fold_scores(spark, d), "market", ["log_loss", "brier"])
    return out.select("fold", "model", r6("log_loss_delta"), r6("brier_delta"))


@query("folds_improved", X.with_views("fscores", """
    SELECT s.model, count(*) AS folds, count(*) FILTER (s.log_loss < b.log_loss) AS log_loss_folds_improved,
      count(*) FILTER (s.brier < b.brier) AS brier_folds_improved, round(avg(b.log_loss - s.log_loss), 6) AS log_loss_gain,
      round(avg(b.brier - s.brier), 6) AS brier_gain
    FROM fscores s JOIN fscores b ON s.fold = b.fold AND b.model = 'market' WHERE s.model <> 'market' GROUP BY 1"""))
def folds_improved(spark, d):
    return r_all(E.folds_improved(fold_scores(spark, d), "market"))


@query("tail_diagnostics", X.with_views("preds", """
    SELECT model, round(avg(p_hat) FILTER (y = 0), 6) AS mean_no, round(quantile_cont(p_hat, 0.95) FILTER (y = 0), 6) AS p95_no,
      round(max(p_hat) FILTER (y = 0), 6) AS max_no, round(avg(p_hat) FILTER (y = 1), 6) AS mean_yes,
      round(quantile_cont(p_hat, 0.05) FILTER (y = 1), 6) AS p05_yes, round(min(p_hat) FILTER (y = 1), 6) AS min_yes FROM preds GROUP BY 1"""))
def tail_diagnostics(spark, d):
    return r_all(E.tail_diagnostics(cut_lineage(predictions(spark, d)), ["model"]))


@query("best_per_group", X.with_views("fscores", """
    SELECT fold, model, round(log_loss, 6) AS log_loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(log_loss, 9), model) AS rn FROM fscores)
    WHERE rn = 1"""))
def best_per_group(spark, d):
    s = fold_scores(spark, d).select("fold", "model", "log_loss")
    return FO.best_per_group(s, ["fold"], [F.round("log_loss", 9), F.col("model")]).withColumn("log_loss", r6("log_loss"))


@query("top_n_per_group", X.with_views("prices markets", """
    SELECT family, market_id, CAST(rank AS INTEGER) AS rank, round(t, 6) AS total FROM (SELECT m.family, market_id, t,
      row_number() OVER (PARTITION BY m.family ORDER BY round(t, 9) DESC, market_id) AS rank
      FROM (SELECT market_id, sum(p) AS t FROM prices GROUP BY 1) JOIN markets m USING (market_id)) WHERE rank <= 5"""))
def top_n_per_group(spark, d):
    totals = X.prices(spark, d).groupBy("market_id").agg(F.sum("p").alias("total")).join(X.markets(spark, d).select("market_id", "family"), "market_id")
    top = FO.top_n_per_group(totals, ["family"], [F.round("total", 9).desc(), F.col("market_id")], 5)
    return top.select("family", "market_id", "rank", r6("total"))


@query("lag_and_delta", X.with_views("hourly", """
    SELECT ts, market_id, round(lag(p) OVER w, 6) AS p_lag1, round(p - lag(p) OVER w, 6) AS p_delta FROM hourly WINDOW w AS (PARTITION BY market_id ORDER BY ts)"""))
def lag_and_delta(spark, d):
    return FO.lag_and_delta(X.hourly(spark, d), ["market_id"], ["p"]).select("ts", "market_id", r6("p_lag1"), r6("p_delta"))


# --- paired comparisons ------------------------------------------------------------------------

PAIR_KEYS = ["fold", "ts", "market_id", "y", "domain"]
X.add_cte("pairs", """
    SELECT fold, ts, market_id, y, domain, max(CASE WHEN model = 'prior' THEN p_hat END) AS pc, max(CASE WHEN model = 'market' THEN p_hat END) AS pb
    FROM preds WHERE model IN ('prior', 'market') GROUP BY 1, 2, 3, 4, 5""", ["preds"])
X.add_cte("gains", """
    SELECT *, -(y * ln(pb) + (1 - y) * ln(1 - pb)) + (y * ln(pc) + (1 - y) * ln(1 - pc)) AS log_gain, (pb - y) * (pb - y) - (pc - y) * (pc - y) AS brier_gain
    FROM pairs""", ["pairs"])


def pairs(spark, d):
    return J.pair_models(predictions(spark, d), "prior", "market", PAIR_KEYS)


@query("pair_join_models", X.with_views("pairs", "SELECT fold, ts, market_id, round(pc, 6) AS p_candidate, round(pb, 6) AS p_baseline FROM pairs"))
def pair_join_models(spark, d):
    return pairs(spark, d).select("fold", "ts", "market_id", r6("p_candidate"), r6("p_baseline"))


@query("domain_gain", X.with_views("gains", """
    WITH g AS (SELECT domain, count(*) AS n_obs, avg(log_gain) AS m, sum(log_gain) AS t FROM gains GROUP BY 1)
    SELECT domain, n_obs, round(m, 6) AS log_loss_gain, round(t / sum(t) OVER (), 6) AS share, m = max(m) OVER () AS is_best,
      t / sum(t) OVER () > 0.75 AS dominates FROM g"""))
def domain_gain(spark, d):
    return r_all(E.domain_gain(cut_lineage(pairs(spark, d))))


@query("paired_loss_test", X.with_views("gains", """
    SELECT count(*) AS paired_rows, round(avg(-log_gain), 6) AS log_loss_delta, round(stddev_samp(log_gain) / sqrt(count(*)), 6) AS log_loss_se,
      round(avg(-log_gain) / (stddev_samp(log_gain) / sqrt(count(*))), 6) AS log_loss_z, round(avg(-brier_gain), 6) AS brier_delta,
      round(stddev_samp(brier_gain) / sqrt(count(*)), 6) AS brier_se,
      round(avg(-brier_gain) / (stddev_samp(brier_gain) / sqrt(count(*))), 6) AS brier_z FROM gains"""))
def paired_loss_test(spark, d):
    return r_all(E.paired_loss_test(pairs(spark, d))).drop("log_loss_p", "brier_p")


def _tail_sql(z):
    t = f"(1.0::DOUBLE / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    return (f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2)")


@query("paired_loss_pvalue", X.with_views("gains", f"""
    WITH t AS (SELECT domain, count(*) AS paired_rows, avg(-log_gain) / (stddev_samp(log_gain) / sqrt(count(*))) AS zl,
      avg(-brier_gain) / (stddev_samp(brier_gain) / sqrt(count(*))) AS zb FROM gains GROUP BY 1)
    SELECT domain, paired_rows, round({_tail_sql('zl')}, 6) AS log_loss_p, round({_tail_sql('zb')}, 6) AS brier_p FROM t"""))
def paired_loss_pvalue(spark, d):
    return E.paired_loss_test(pairs(spark, d), ["domain"]).select("domain", "paired_rows", r6("log_loss_p"), r6("brier_p"))


REPLICATES = 200


def _boot_sql(unit, label, gains="gains", extra=""):
    text = " || ':' || ".join("strftime(ts, '%Y-%m-%d %H:%M:%S')" if u == "ts" else u for u in unit)
    steps = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in E.POISSON_STEPS)
    return f"""
    SELECT {extra}'{label}' AS cluster, any_value(n_units) AS n_units, round(any_value(ml), 6) AS log_gain_mean, round(any_value(mb), 6) AS brier_gain_mean,
      round(quantile_cont(lg, 0.025), 6) AS log_gain_ci_low, round(quantile_cont(lg, 0.975), 6) AS log_gain_ci_high,
      round(quantile_cont(bg, 0.025), 6) AS brier_gain_ci_low, round(quantile_cont(bg, 0.975), 6) AS brier_gain_ci_high
    FROM (SELECT r, sum(w * l) / sum(w * n) AS lg, sum(w * b) / sum(w * n) AS bg FROM (
        SELECT r, l, b, n, {steps} AS w FROM (SELECT r, l, b, n, ((a + c * r) % {E.PRIME}) / {float(E.PRIME)}::DOUBLE AS u
          FROM (SELECT sum(log_gain) AS l, sum(brier_gain) AS b, count(*) AS n, CAST('0x' || substr(md5('7:' || {text}), 1, 7) AS BIGINT) AS a,
                CAST('0x' || substr(md5('7:' || {text}), 8, 7) AS BIGINT) AS c FROM {gains} GROUP BY {', '.join(unit)}),
               (SELECT unnest(generate_series(1, {REPLICATES})) AS r))) GROUP BY 1),
      (SELECT count(*) AS n_units, (SELECT avg(log_gain) FROM {gains}) AS ml, (SELECT avg(brier_gain) FROM {gains}) AS mb
       FROM (SELECT DISTINCT {', '.join(unit)} FROM {gains}))"""


def _boot(losses, unit, label):
    out = E.bootstrap(losses, [], unit, ["log_gain", "brier_gain"], REPLICATES, one_row_each=label == "row")
    return r_all(out).withColumn("cluster", F.lit(label))


@query("bootstrap_row", X.with_views("gains", _boot_sql(["fold", "ts", "market_id"], "row")))
def bootstrap_row(spark, d):
    return _boot(cut_lineage(E.paired_losses(pairs(spark, d))), ["fold", "ts", "market_id"], "row")


@query("bootstrap_cluster", X.with_views("gains", _boot_sql(["market_id"], "market_id") + " UNION ALL " + _boot_sql(["ts"], "ts")))
def bootstrap_cluster(spark, d):
    losses = cut_lineage(E.paired_losses(pairs(spark, d)))
    return M.union_models([_boot(losses, ["market_id"], "market_id"), _boot(losses, ["ts"], "ts")])


COMPARISONS = (("prior", "market"), ("shrunk", "market"), ("prior", "shrunk"))
UNITS = ((["fold", "ts", "market_id"], "row"), (["market_id"], "market_id"), (["ts"], "ts"))


def _gains_sql(candidate, baseline):
    return f"""(SELECT fold, ts, market_id, -(y * ln(pb) + (1 - y) * ln(1 - pb)) + (y * ln(pc) + (1 - y) * ln(1 - pc)) AS log_gain,
      (pb - y) * (pb - y) - (pc - y) * (pc - y) AS brier_gain FROM (SELECT fold, ts, market_id, y, max(CASE WHEN model = '{candidate}' THEN p_hat END) AS pc,
      max(CASE WHEN model = '{baseline}' THEN p_hat END) AS pb FROM preds GROUP BY 1, 2, 3, 4))"""


@query("stat_test_table", X.with_views("preds", "WITH " + ", ".join(
    f"g{i} AS {_gains_sql(*c)}" for i, c in enumerate(COMPARISONS)) + " " + " UNION ALL ".join(
    _boot_sql(u, n, f"g{i}", f"'{c}' AS candidate, '{b}' AS baseline, ") for i, (c, b) in enumerate(COMPARISONS) for u, n in UNITS)))
def stat_test_table(spark, d):
    p = cut_lineage(predictions(spark, d))
    parts = []
    for candidate, baseline in COMPARISONS:
        losses = cut_lineage(E.paired_losses(J.pair_models(p, candidate, baseline, PAIR_KEYS)))
        tag = {"candidate": F.lit(candidate), "baseline": F.lit(baseline)}
        parts += [_boot(losses, u, n).withColumns(tag) for u, n in UNITS]
    return M.union_models(parts)
