"""Model comparison, nested selection and the locked benchmark, on families of fits that are solved together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import evaluate as E
from tidepanel.operators import fits as T
from tidepanel.operators import folds as FO
from tidepanel.operators import graph as G
from tidepanel.operators import joins as J
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.plans.graphs import neighbours, train_corr
from tidepanel.plans.learning import BASE, Setup, project
from tidepanel.plans.registry import query
from tidepanel.plans.scoring import INNER, PAIR_KEYS, REPLICATES, UNITS, r_all
from tidepanel.session import cut_lineage, spread

# Inverse penalties that are tried, the size of the locked neighbourhoods, and how far a placebo looks ahead.
PENALTIES = (1.0, 0.1, 0.01)
LOCKED_K, PLACEBO_HOURS = 20, 24

GRAPH_COLUMNS = ("edges", "components", "cycle_rank", "edge_density", "avg_degree", "clustering")
TOPOLOGY = [f"t{round(10 * t)}_{c}" for t in G.THRESHOLDS for c in GRAPH_COLUMNS]
CONTROLS = ["corr_mean_abs", "corr_std_abs", "prob_mean", "prob_std", *[f"t{round(10 * t)}_{c}" for t in G.THRESHOLDS for c in ("edge_density", "clustering")]]
KEEP = ["ts", "market_id", "y", "p", "domain", "family", "n_active"]


def pca(k, prefix="pca"):
    return [f"{prefix}_{i + 1}" for i in range(k)]


class Comparison(Setup):
    """Rows of any folds with the fold's component scores and its neighbourhoods' graphs and controls."""

    def __init__(self, spark, d, folds=None):
        super().__init__(spark, d)
        if folds is not None:
            self.folds = cut_lineage(folds(self))

    def hoods(self):
        """One row per fold and market: graphs of its nearest markets by training correlation, and plain summaries of the same markets."""
        train = self.members.where("split = 'train'").select("fold", "ts")
        live = cut_lineage(G.varying(P.dense_fill(self.hourly).join(train, "ts"), ["fold"]))
        corr = train_corr(live)
        near = neighbours(corr, LOCKED_K)
        graphs = G.neighborhood_graphs(near, corr, ["fold"])
        wide = graphs.groupBy("fold", "owner").agg(*[
            F.max(F.when(F.col("t") == t, F.col(c))).cast("double").alias(f"t{round(10 * t)}_{c}") for t in G.THRESHOLDS for c in GRAPH_COLUMNS])
        return cut_lineage(wide.join(G.neighborhood_controls(near, corr, keys=["fold"]), ["fold", "owner"]).withColumnRenamed("owner", "market_id"))

    def features(self, k, placebos=False):
        """Train and test rows of every fold with their features; with placebos, also shuffled graphs and later scores."""
        v, hoods = self.vectors(), self.hoods()
        scores = cut_lineage(project(v, self.bases(v), k))
        rows = spread(self.rows).join(self.members, "ts").join(scores, ["fold", "ts"]).join(hoods, ["fold", "market_id"], "left")
        if placebos:
            shuffled = FO.placebo_shuffle(hoods.select("fold", "market_id", *TOPOLOGY), TOPOLOGY, 7, "market_id", within=["fold"])
            rows = rows.join(shuffled.withColumnsRenamed({c: f"placebo_{c}" for c in TOPOLOGY}), ["fold", "market_id"], "left")
            later = FO.placebo_future_shift(scores, PLACEBO_HOURS).withColumnsRenamed(dict(zip(pca(k), pca(k, "later"))))
            rows = rows.join(later, ["fold", "ts"], "left")
        return rows

    def label_sets(self, rows):
        """The rows once for training on all outcomes, once for training on markets closed at the fold's end."""
        closed = self.markets.select("market_id", "close_ts")
        told = rows.join(closed, "market_id").join(self.folds.select("fold", "train_end"), "fold")
        sets = F.when((F.col("split") == "test") | (F.col("close_ts") <= F.col("train_end")), F.array(F.lit("all"), F.lit("known"))).otherwise(F.array(F.lit("all")))
        return told.withColumn("labels", F.explode(sets)).drop("close_ts", "train_end")


GROUPS = {"pca": [], "pca_controls": CONTROLS, "pca_topology": TOPOLOGY, "pca_controls_topology": [*CONTROLS, *TOPOLOGY]}
FITS = [T.Fit(f"logit_{name}_C{c:g}", (*BASE, *pca(5), *extra), c) for name, extra in GROUPS.items() for c in PENALTIES]
COLUMNS = [*BASE, *pca(5), *dict.fromkeys([*CONTROLS, *TOPOLOGY])]


def compared(spark, d, labels=True):
    """Test predictions of the price itself and of every specification, written."""
    s = Comparison(spark, d)
    rows = s.features(5)
    rows = s.label_sets(rows) if labels else rows.withColumn("labels", F.lit("all"))
    fitted = T.Fitted(T.Design(rows, ["fold", "labels"], COLUMNS, KEEP), FITS)
    test = fitted.design.raw.where("split = 'test'")
    market = test.select("fold", "labels", F.lit("market_probability").alias("model"), *KEEP, F.col("p").alias("p_hat"))
    return s, fitted, cut_lineage(market.unionByName(fitted.tested()))


@query("model_comparison")
def model_comparison(spark, d):
    """Fold means of every specification and penalty, trained on all outcomes and on those known at the fold's end."""
    _, _, pred = compared(spark, d)
    keys = ["labels", "fold", "model"]
    scores = E.scores_of_counts(pred, keys)
    means = [F.avg(c).alias(f"fold_mean_{c}") for c in ("log_loss", "brier", "avg_pred", "avg_actual", "auc")]
    return r_all(scores.groupBy("labels", "model").agg(F.countDistinct("fold").alias("folds"), F.sum("n_obs").alias("n_obs"), *means))


@query("model_comparison_slices")
def model_comparison_slices(spark, d):
    """Scores of the specifications at the strongest penalty, per fold and slice of domain, family, label, crowd and price."""
    pred = compared(spark, d, labels=False)[2].where("model LIKE '%_C0.01' OR model = 'market_probability'")
    return r_all(E.result_slices(pred, ["fold", "model"]))


PAIRED = (("logit_pca_controls_topology_C0.01", "logit_pca_controls_C0.01"), ("logit_pca_controls_topology_C0.01", "logit_pca_C0.01"))


@query("model_comparison_tests")
def model_comparison_tests(spark, d):
    """What graphs add to controls, and both to components: resampled gains by row, market and hour, and the folds improved."""
    pred = compared(spark, d, labels=False)[2]
    scores = cut_lineage(E.score_predictions(pred, ["fold", "model"]))
    parts = []
    for candidate, baseline in PAIRED:
        tag = {"candidate": F.lit(candidate), "baseline": F.lit(baseline)}
        losses = cut_lineage(E.paired_losses(J.pair_models(pred, candidate, baseline, PAIR_KEYS)))
        boots = [E.bootstrap(losses, [], u, ["log_gain", "brier_gain"], REPLICATES, one_row_each=n == "row").withColumn("cluster", F.lit(n)) for u, n in UNITS]
        folds = E.folds_improved(scores.where(F.col("model").isin(candidate, baseline)), baseline).select(
            F.lit("fold_count").alias("cluster"), F.col("folds").alias("n_units"), F.col("log_loss_gain").alias("log_gain_mean"), F.col("brier_gain").alias("brier_gain_mean"),
            "log_loss_folds_improved", "brier_folds_improved")
        parts.append(M.union_models(boots).unionByName(folds, allowMissingColumns=True).withColumns(tag))
    return r_all(M.union_models(parts))


def _specs_sql():
    named = ", ".join(f"('{f.name}', '{c}')" for f in FITS for c in ("intercept", *dict.fromkeys(f.columns)))
    return f"(SELECT * FROM (VALUES {named}) AS v(m, f))"


@query("fit_score_equations", X.with_views("sup folds", f"""
    WITH tr AS (SELECT f.fold, count(*) AS n_train, CAST(sum(y) AS BIGINT) AS n_yes FROM sup s JOIN folds f ON s.ts BETWEEN f.train_start AND f.train_end
      GROUP BY 1 HAVING min(y) < max(y))
    SELECT fold, s.m AS model, s.f AS feature, n_train, n_yes, 0.0::DOUBLE AS slope FROM tr, {_specs_sql()} s"""))
def fit_score_equations(spark, d):
    """The slope of every objective at its solution, summed anew over the training rows by Spark's own aggregates: nil for each fold, specification and column."""
    s, fitted, _ = _family(spark, d)
    train = fitted.predictions(fitted.design.raw.where("split = 'train' AND y IS NOT NULL"), x=True)
    error = F.col("hat") - F.col("y")
    sums = train.groupBy("fold", "model").agg(F.count("*").alias("n_train"), F.sum("y").cast("long").alias("n_yes"), F.array(
        F.sum(error), *[F.sum(error * F.col("x")[i]) for i in range(len(COLUMNS))]).alias("sums"))
    by_name, rows = {f.name: f for f in FITS}, []
    for g, model, column, b in fitted.coefficients():
        places, shrink = fitted.design.index(by_name[model])
        at = 0 if column == "intercept" else 1 + COLUMNS.index(column)
        rows.append((int(g.split("|")[0]), model, column, at, by_name[model].c, float(shrink[list(places).index(at)]) * b))
    told = spark.createDataFrame(rows, "fold int, model string, feature string, at int, c double, pull double")
    slope = F.round(F.col("c") * F.col("sums")[F.col("at")] + F.col("pull"), 7) + 0.0
    return sums.join(told, ["fold", "model"]).select("fold", "model", "feature", "n_train", "n_yes", slope.alias("slope"))


def _family(spark, d):
    s = Comparison(spark, d)
    fitted = T.Fitted(T.Design(s.features(5).withColumn("labels", F.lit("all")), ["fold", "labels"], COLUMNS, KEEP), FITS)
    return s, fitted, None


# --- nested selection and the locked benchmark ---------------------------------------------------

INNER_FOLDS, HOLDOUT = 1000, 999
PCA_SETTINGS = (2, 5, 10)
REPRESENTATIONS = [("pca_only", f"fixed_{k}", tuple(pca(k)), ()) for k in PCA_SETTINGS] + [("topology_only", "none", (), tuple(TOPOLOGY))] + [
    ("pca_plus_topology", f"fixed_{k}", tuple(pca(k)), tuple(TOPOLOGY)) for k in PCA_SETTINGS]
CONFIGS = [(r, setting, c, T.Fit(f"{r}|{setting}|{c:g}", (*BASE, *scores, *graphs), c)) for r, setting, scores, graphs in REPRESENTATIONS for c in PENALTIES]


def _chosen(pred):
    """The best configuration of every representation in each inner fold: least log loss, then Brier, then the stronger penalty and its name."""
    parts = F.split("model", r"\|")
    scores = E.score_predictions(pred, ["fold", "model"]).select(
        (F.col("fold") - INNER_FOLDS).alias("fold"), parts[0].alias("representation"), parts[1].alias("pca_setting"), parts[2].cast("double").alias("c_value"), "n_obs", "log_loss", "brier")
    return FO.best_per_group(scores, ["fold", "representation"], [F.round("log_loss", 9), F.round("brier", 9), F.col("c_value"), F.col("pca_setting")])


def nested_folds(holdout):
    """The validation fold inside every outer fold's training hours, and, if asked for, the locked holdout."""

    def make(s):
        outer = FO.chronological_folds(s.cells, 0.60, 48, 48, 24)
        inner = FO.inner_validation(s.cells, cut_lineage(outer), **INNER).withColumn("fold", F.col("fold") + INNER_FOLDS)
        return inner.unionByName(FO.locked_holdout(s.cells)) if holdout else inner

    return make


INNER_COLUMNS = [*BASE, *pca(10), *TOPOLOGY]


@query("nested_selection")
def nested_selection(spark, d):
    """What each representation selects on the validation part of every fold, over all its component settings and penalties."""
    s = Comparison(spark, d, nested_folds(False))
    fitted = T.Fitted(T.Design(s.features(10), ["fold"], INNER_COLUMNS, KEEP), [c[3] for c in CONFIGS])
    return r_all(_chosen(fitted.tested()))


@query("locked_benchmark")
def locked_benchmark(spark, d):
    """The holdout scored once: the price, the configuration that each representation selects in most folds, and its placebos.

    Graph placebos hand each market the graphs of another one, component placebos show the scores of a day later.
    """
    s = Comparison(spark, d, nested_folds(True))
    columns = [*INNER_COLUMNS, *[f"placebo_{c}" for c in TOPOLOGY], *pca(10, "later")]
    design = T.Design(s.features(10, placebos=True), ["fold"], columns, KEEP)
    fits = [c[3] for c in CONFIGS]
    swap = lambda c: f"placebo_{c}" if c in TOPOLOGY else c.replace("pca_", "later_")
    fakes = [T.Fit(f"placebo_{f.name}", (*BASE, *map(swap, f.columns[len(BASE):])), f.c) for f in fits]
    fitted = T.Fitted(design, [*fits, *fakes])
    pred = cut_lineage(fitted.tested())
    locked = FO.choose_locked_config(cut_lineage(_chosen(pred.where(f"fold > {HOLDOUT} AND model NOT LIKE 'placebo%'"))), ["pca_setting", "c_value"]).collect()  # a row per representation
    names = {f"{r['representation']}|{r['pca_setting']}|{r['c_value']:g}": r for r in locked}
    told = pred.where(F.col("fold") == HOLDOUT).where(F.col("model").isin([*names, *[f"placebo_{n}" for n in names]]))
    market = design.raw.where(f"split = 'test' AND fold = {HOLDOUT}").select("fold", *KEEP, F.lit("market_probability").alias("model"), F.col("p").alias("p_hat"))
    every = cut_lineage(told.unionByName(market))
    scores = cut_lineage(E.scores_of_counts(every, ["model"]))
    base = scores.where("model = 'market_probability'").select(F.col("log_loss").alias("l0"), F.col("brier").alias("b0"))
    gains = scores.withColumns({"log_loss_gain": base.select("l0").scalar() - F.col("log_loss"), "brier_gain": base.select("b0").scalar() - F.col("brier")})
    return r_all(gains.withColumn("model", F.regexp_replace("model", r"\|", "_")))
